"""Further forms of filters, windows, JSON, row changes and sources as queries over the test tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions import dates, json_text, jsonb, maths, register
from marlpit.operators import dml, windows
from marlpit.plans import relational
from marlpit.plans.relational import r2
from marlpit.session import ConstraintError, Session, TableMeta, shared_folder
from marlpit.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _moved(name: str) -> None:
    QUERIES[name] = relational.QUERIES.pop(name)
    if name in relational.ORACLES:
        ORACLES[name] = relational.ORACLES.pop(name)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    relational.sql(name, text, oracle)
    _moved(name)


def frame(name: str, oracle: str | None):
    add = relational.frame(name, oracle)

    def moved(f):
        add(f)
        _moved(name)
        return f

    return moved


# --- filters, grouping, windows ---

sql("filter_ilike", "SELECT p_partkey FROM {part} WHERE p_name ILIKE '%A%E%' AND p_type NOT ILIKE 's%'")
sql("filter_regexp_nocase", "SELECT p_partkey FROM {part} WHERE p_name RLIKE '(?i)^[A-M].*E' AND NOT p_type RLIKE '(?i)STEEL$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[A-M].*E', 'i') AND NOT regexp_matches(p_type, 'STEEL$', 'i')")
sql("interval_arithmetic", "SELECT event_id, ts + INTERVAL '3' DAY AS later, ts - INTERVAL '90' MINUTE AS sooner FROM {events}", "SELECT event_id, ts + INTERVAL 3 DAY AS later, ts - INTERVAL 90 MINUTE AS sooner FROM events")
sql("group_concat_distinct", "SELECT c_nationkey, array_join(sort_array(collect_set(c_mktsegment)), ';') AS segments FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")


@frame("collation_filter", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12' OR rtrim(p_brand) = 'Brand#13'")
def _(t, spark):
    x = F.col("p_brand")
    return t("part").where((register.nocase(x) == register.nocase(F.lit("BRAND#12"))) | (register.rtrim(x) == "Brand#13")).select("p_partkey")


@frame("collation_distinct", "SELECT p_brand, count(DISTINCT lower(p_type)) AS n FROM part GROUP BY p_brand")
def _(t, spark):
    return t("part").groupBy("p_brand").agg(F.countDistinct(register.nocase(F.col("p_type"))).alias("n"))


@frame("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER w AS n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    counted = F.col("o_orderstatus") == "F"
    return t("orders").select("o_orderkey", F.count_if(counted).over(w).alias("n"), F.max(F.when(counted, F.col("o_totalprice"))).over(w).alias("top"))


@frame("win_distinct", "SELECT l_orderkey, l_linenumber, count(DISTINCT nullif(l_returnflag, 'N')) OVER (PARTITION BY l_suppkey) AS n FROM lineitem")
def _(t, spark):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.expr("nullif(l_returnflag, 'N')").alias("flag"))
    return windows.count_distinct_over(rows, "flag", ["l_suppkey"], "n").select("l_orderkey", "l_linenumber", "n")


@frame("win_user_aggregate", "SELECT o_orderkey, max(o_totalprice) OVER w - min(o_totalprice) OVER w AS spread FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(t, spark):
    def spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, starts) - np.minimum.reduceat(values, starts)

    f = register.frame_aggregate(spark, "mp_spread", spread, "double")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-4, 0)
    return t("orders").select("o_orderkey", f("o_totalprice", w).alias("spread"))


# --- functions ---


@frame(
    "fn_hyperbolic",
    "SELECT p_partkey, "
    + ", ".join(f"{r2(f'{f}({x})')} AS {f}" for f, x in [("sinh", "p_size / 10.0"), ("cosh", "p_size / 10.0"), ("tanh", "p_size / 10.0"), ("asinh", "p_size / 10.0")])
    + f", CASE WHEN p_size >= 10 THEN {r2('acosh(greatest(p_size / 10.0, 1.0))')} END AS acosh, CASE WHEN p_size < 10 THEN {r2('atanh(least(p_size / 10.0, 0.9))')} END AS atanh FROM part",
)
def _(t, spark):
    x = F.col("p_size") / 10.0
    names = ["sinh", "cosh", "tanh", "asinh", "acosh", "atanh"]
    found = t("part").select("p_partkey", *(maths.one_argument(f, x).alias(f) for f in names))
    return found.selectExpr("p_partkey", *(f"{r2(f)} AS {f}" for f in names))


@frame("fn_date_no_shift", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS same, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day FROM events")
def _(t, spark):
    x = F.col("ts")
    return t("events").select("event_id", dates.datetime_text(dates.modify(x, "utc", "localtime", "subsec")).alias("same"), dates.datetime_text(dates.modify(x, "auto", "start of day")).alias("day"))


# --- JSON ---

_PARTS = "concat('{{\"size\":', p_size, ',\"tags\":[\"', p_brand, '\",null],\"none\":null}}')".replace("{{", "{").replace("}}", "}")


def _docs(t) -> DataFrame:
    return t("part").select("p_partkey", F.expr(_PARTS).alias("doc"))


@frame("json_insert_nested", "SELECT p_partkey, '{\"size\":' || p_size || ',\"tags\":[\"' || p_brand || '\",null,7],\"none\":null}' AS more, '{\"size\":' || p_size || ',\"tags\":[\"' || p_brand || '\",null],\"none\":null}' AS same, '[' || p_size || ',\"' || p_brand || '\"]' AS both FROM part")
def _(t, spark):
    x = F.col("doc")
    return _docs(t).select("p_partkey", json_text.insert(x, "$.tags[#]", F.lit("7")).alias("more"), json_text.insert(x, "$.size", F.lit("0")).alias("same"), json_text.extract_all(x, "$.size", "$.tags[0]").alias("both"))


@frame("jsonb_set_insert", "SELECT p_partkey, '{\"size\": 0, \"tags\": [\"' || p_brand || '\", null], \"none\": null}' AS s, '{\"size\": ' || p_size || ', \"tags\": [\"' || p_brand || '\", null], \"none\": null}' AS kept, '{\"size\": ' || p_size || ', \"tags\": [1, \"' || p_brand || '\", null], \"none\": null}' AS first, '{\"size\": ' || p_size || ', \"tags\": [\"' || p_brand || '\", 1, null], \"none\": null}' AS second FROM part")
def _(t, spark):
    x, one = F.col("doc"), F.lit("1")
    return _docs(t).select(
        "p_partkey", jsonb.set_(x, ("size",), F.lit("0")).alias("s"), jsonb.set_(x, ("more",), one, create=False).alias("kept"),
        jsonb.insert(x, ("tags", "0"), one).alias("first"), jsonb.insert(x, ("tags", "0"), one, after=True).alias("second"),
    )


@frame("jsonb_delete_concat", "SELECT p_partkey, '{\"size\": ' || p_size || '}' AS less, '{\"size\": ' || p_size || ', \"tags\": [null], \"none\": null}' AS cut, '{\"size\": 1, \"tags\": [\"' || p_brand || '\", null], \"none\": null, \"z\": 2}' AS joined, '[' || p_size || ', ' || p_size || ', 3]' AS items FROM part")
def _(t, spark):
    x = F.col("doc")
    return t("part").select("p_partkey", "p_size", F.expr(_PARTS).alias("doc")).select(
        "p_partkey", jsonb.delete(x, "tags", "none").alias("less"), jsonb.delete_path(x, ("tags", "0")).alias("cut"), jsonb.concat(x, F.lit('{"size":1,"z":2}')).alias("joined"),
        jsonb.concat(F.col("p_size").cast("string"), F.concat(F.lit("["), "p_size", F.lit(",3]"))).alias("items"),
    )


@frame("jsonb_strip_pretty", "SELECT p_partkey, '{\"size\": ' || p_size || ', \"tags\": [\"' || p_brand || '\", null]}' AS stripped, '{' || chr(10) || '    \"size\": ' || p_size || chr(10) || '}' AS pretty FROM part")
def _(t, spark):
    x = F.col("doc")
    return _docs(t).select("p_partkey", jsonb.strip_nulls(x).alias("stripped"), jsonb.pretty(jsonb.delete(x, "tags", "none")).alias("pretty"))


@frame("jsonb_at_path", "SELECT p_partkey, '\"' || p_brand || '\"' AS item, p_brand AS plain, CAST(p_size AS VARCHAR) AS size, NULL AS nothing FROM part")
def _(t, spark):
    x = F.col("doc")
    return _docs(t).select("p_partkey", jsonb.at_path(x, "tags", 0).alias("item"), jsonb.text_at_path(x, "tags", 0).alias("plain"), jsonb.at_path(x, "size").alias("size"), jsonb.text_at_path(x, "tags", 9).alias("nothing"))


# --- row changes ---


@frame("dml_move_rows", "SELECT 'kept' AS place, c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'moved', c_custkey FROM customer WHERE c_acctbal < 0")
def _(t, spark):
    # WITH gone AS (DELETE … RETURNING *) INSERT INTO … SELECT: both tables afterwards
    c = t("customer").select("c_custkey", "c_acctbal")
    gone = c.where("c_acctbal < 0")
    archive = dml.insert(c.limit(0), gone)
    return dml.delete(c, F.expr("c_acctbal < 0")).select(F.lit("kept").alias("place"), "c_custkey").unionAll(archive.select(F.lit("moved"), "c_custkey"))


@frame("view_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'new ' || n_name, n_regionkey FROM nation")
def _(t, spark):
    # INSTEAD OF INSERT on a view that joins nation and region: the rows go to nation, the region found by its name
    view = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    new = view.select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat(F.lit("new "), "n_name").alias("n_name"), "r_name")
    rows = new.join(t("region"), "r_name").select("n_nationkey", "n_name", F.col("r_regionkey").alias("n_regionkey"))
    return dml.insert(t("nation").select("n_nationkey", "n_name", "n_regionkey"), rows)


@frame("row_trigger_ignore", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_acctbal >= 0")
def _(t, spark):
    # BEFORE INSERT WHEN new.c_acctbal < 0 RAISE(IGNORE), as a set
    c = t("customer").select("c_custkey", "c_acctbal")
    return dml.insert(c, c.withColumn("c_custkey", F.col("c_custkey") + 1_000_000).where("NOT coalesce(c_acctbal < 0, false)"))


@frame("constraint_violations", "SELECT * FROM (VALUES ('check'), ('foreign key'), ('not null'), ('unique')) AS v(broken)")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("nation", t("nation"), TableMeta(primary_key=["n_nationkey"]))
    c = t("customer").where("c_nationkey < 20")
    s.create("c", c, TableMeta(primary_key=["c_custkey"], not_null=["c_name"], checks={"nation": "c_nationkey < 100"}, foreign_keys=[("c_nationkey", "nation", "n_nationkey")]))
    bad = {"unique": c.unionAll(c), "not null": c.withColumn("c_name", F.expr("nullif(c_name, c_name)")), "check": c.withColumn("c_nationkey", F.lit(100)), "foreign key": c.withColumn("c_nationkey", F.lit(99))}

    def fails(df: DataFrame) -> bool:
        try:
            s.check("c", df)
        except ConstraintError:
            return True
        return False

    return spark.createDataFrame([(name,) for name, df in bad.items() if fails(df)], "broken string")


# --- sources ---


@frame("output_modes_more", "SELECT n_nationkey || chr(9) || n_name AS line FROM nation UNION ALL SELECT n_nationkey || ',' || n_name FROM nation UNION ALL SELECT n_nationkey || ',''' || n_name || '''' FROM nation UNION ALL SELECT 'n_nationkey = ' || n_nationkey || chr(10) || 'n_name = ' || n_name FROM nation UNION ALL SELECT '<TR><TD>' || n_nationkey || '</TD><TD>' || n_name || '</TD></TR>' FROM nation UNION ALL SELECT '\"' || n_nationkey || '\" \"' || n_name || '\"' FROM nation UNION ALL SELECT n_nationkey || chr(31) || n_name FROM nation UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation")
def _(t, spark):
    rows = t("nation").select("n_nationkey", "n_name")
    out = tables.rendered(rows, "tabs")
    for mode in ("csv", "quote", "line", "html", "tcl", "ascii", "markdown"):
        out = out.unionAll(tables.rendered(rows, mode))
    return out


@frame("output_columns", "SELECT '| ' || rpad(CAST(n_nationkey AS VARCHAR), CAST((SELECT max(length(CAST(n_nationkey AS VARCHAR))) FROM nation) AS INTEGER), ' ') || ' | ' || rpad(n_name, CAST((SELECT max(length(n_name)) FROM nation) AS INTEGER), ' ') || ' |' AS line FROM nation")
def _(t, spark):
    return tables.aligned(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")), "table")


@frame("compacted_copy", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t, spark):
    path = f"{shared_folder(spark)}/compact-{uuid.uuid4().hex}"
    tables.compact(t("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").parquet(path)


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join across the session's own tables and those of an attached folder."""
    s = Session(spark, configure=False)
    s.create("nation", tables.load(spark, sf_dir, "nation"))
    s.attach("other", sf_dir, ["region"])
    n, r = s.tables["nation"], s.tables["other.region"]
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


QUERIES["attach_folder"] = _attached
ORACLES["attach_folder"] = "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
