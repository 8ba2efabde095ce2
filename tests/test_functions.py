"""Edge cases of the function library on inline rows."""

import pytest
from pyspark.sql import functions as F

from marlpit.functions import dates, json_text, maths, strings, vectors
from marlpit.operators import aggregates


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("start,length,wanted", [(1, 2, "ab"), (0, 3, "ab"), (-2, None, "ef"), (-9, 5, "ab"), (4, -2, "bc"), (3, 0, ""), (9, 2, ""), (0, -2, "")])
def test_substr(spark, start, length, wanted):
    assert one(spark, strings.substr(F.lit("abcdef"), start, length)) == wanted


def test_strings(spark):
    assert one(spark, strings.ascii_lower(F.lit("ÀBc"))) == "Àbc"
    assert one(spark, strings.instr(F.lit("abc"), F.lit(""))) == 1
    assert one(spark, strings.replace(F.lit("abc"), F.lit(""), F.lit("x"))) == "abc"
    assert one(spark, strings.hex_text(F.lit(None).cast("string"))) == ""
    assert one(spark, strings.unhex_text(F.lit("zz"))) is None
    assert one(spark, strings.quote(F.lit("it's"))) == "'it''s'"
    assert one(spark, strings.cast_integer(F.lit(" -12abc"))) == -12
    assert one(spark, strings.cast_integer(F.lit("abc"))) == 0
    assert one(spark, strings.scalar_min(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, strings.like(F.lit("A_c"), "a#_C", "#")) is True
    assert one(spark, strings.glob(F.lit("file[1]"), "file[[]?]")) is True
    assert one(spark, strings.similar_to(F.lit("a.b"), "a.b")) is True
    assert one(spark, strings.similar_to(F.lit("axb"), "a.b")) is False
    for holds in (strings.like(F.lit("abc\n"), "abc"), strings.glob(F.lit("abc\n"), "abc"), strings.similar_to(F.lit("abc\n"), "abc")):
        assert one(spark, holds) is False
    assert one(spark, strings.glob(F.lit("b"), "[!a]")) is True and one(spark, strings.glob(F.lit("a"), "[!a]")) is False
    assert one(spark, strings.similar_to(F.lit("5%"), "5#%", "#")) is True and one(spark, strings.similar_to(F.lit("55"), "5#%", "#")) is False
    assert one(spark, strings.printf("%i%%|%5s", F.lit(None).cast("int"), F.lit("x"))) == "0%|    x"
    assert one(spark, strings.char(F.lit(0x1F600))) == "😀"


def test_maths(spark):
    assert one(spark, maths.round_away(F.lit(1.005), 2)) == 1.0
    assert one(spark, maths.divide(F.lit(-7), F.lit(2), True)) == -3
    assert one(spark, maths.divide(F.lit(1), F.lit(0), True)) is None
    assert one(spark, maths.remainder(F.lit(-7), F.lit(3))) == -1
    assert one(spark, maths.ln(F.lit(-1.0))) is None
    assert one(spark, maths.power(F.lit(10.0), F.lit(400.0))) is None
    assert one(spark, maths.trunc(F.lit(-2.7))) == -2.0


def test_dates(spark):
    ts = F.expr("timestamp_ntz '2024-01-31 10:20:30'")
    assert one(spark, dates.date_text(dates.modify(ts, "+1 month"))) == "2024-03-02"
    assert one(spark, dates.date_text(dates.modify(ts, "start of year", "-1 day"))) == "2023-12-31"
    assert one(spark, dates.date_text(dates.modify(ts, "weekday 3"))) == "2024-01-31"
    assert one(spark, dates.julianday(F.expr("timestamp_ntz '2000-01-01 12:00:00'"))) == 2451545.0
    assert one(spark, dates.datetime_text(dates.from_julian(F.lit(2451545.0)))) == "2000-01-01 12:00:00"
    assert one(spark, dates.datetime_text(dates.parse(F.lit("12:30")))) == "2000-01-01 12:30:00"
    assert one(spark, dates.parse(F.lit("nonsense"))) is None
    with pytest.raises(ValueError):
        dates.modify(ts, "+1 fortnight")


def test_json(spark):
    doc = F.lit('{"a":{"b":[1,2,3]},"n":null}')
    assert one(spark, json_text.extract(doc, "$.a.b[#-1]")) == "3"
    assert one(spark, json_text.extract_json(doc, "$.a.b")) == "[1,2,3]"
    assert one(spark, json_text.kind(doc, "$.a")) == "object"
    assert one(spark, json_text.set_(doc, "$.a.c", F.lit("5"))) == '{"a":{"b":[1,2,3],"c":5},"n":null}'
    assert one(spark, json_text.insert(doc, "$.a.b[#]", F.lit("4"))) == '{"a":{"b":[1,2,3,4]},"n":null}'
    assert one(spark, json_text.remove(doc, "$.a.b[0]", "$.n")) == '{"a":{"b":[2,3]}}'
    assert one(spark, json_text.patch(doc, F.lit('{"a":null,"z":1}'))) == '{"n":null,"z":1}'
    assert one(spark, json_text.strip_nulls(doc)) == '{"a":{"b":[1,2,3]}}'
    assert one(spark, json_text.contains(doc, F.lit('{"a":{"b":[3,1]}}'))) is True
    assert one(spark, json_text.valid(F.lit('{"a":1}}'))) is False
    assert one(spark, json_text.remove(F.lit("not json"), "$.a")) is None


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert one(spark, vectors.l2(a, b)) == 5.0
    assert one(spark, vectors.cosine(a, b)) == 1.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_aggregates_of_nothing(spark):
    empty = spark.range(0).select(F.col("id").cast("string").alias("x"), F.col("id").alias("k"))
    row = empty.agg(aggregates.total(F.col("k")).alias("t"), aggregates.group_concat(F.col("x")).alias("g"), aggregates.json_group_object(F.col("x"), F.col("k")).alias("o")).first()
    assert tuple(row) == (0.0, None, "{}")
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), (None, 4)], "x string, k int")
    row = rows.agg(aggregates.group_concat(F.col("x"), "-").alias("g"), aggregates.json_group_object(F.col("x"), F.col("k")).alias("o"), aggregates.json_group_array(F.col("x"), F.col("k")).alias("a")).first()
    assert tuple(row) == ("a-a-b", '{"a":3,"b":1}', '["b","a","a",null]')
