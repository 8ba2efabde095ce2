"""Sessions, constraints, streams and the optional part's guard."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from marlpit.operators import aggregates, dml, windows
from marlpit.operators.recursion import recursive_union
from marlpit.session import ConstraintError, Session, TableMeta
from marlpit.sources.tables import load
from marlpit.streaming import events


def test_constraints_and_savepoints(spark):
    s = Session(spark, configure=False)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    s.create("t", rows, TableMeta(primary_key=["id"], checks={"small": "id < 10"}))
    with pytest.raises(ConstraintError):
        s.check("t", rows.unionAll(rows))
    with pytest.raises(ConstraintError):
        s.check("t", spark.createDataFrame([(11, "x")], "id int, name string"))
    with pytest.raises(ConstraintError):
        dml.insert_or_abort(s.tables["t"], rows.limit(1), ["id"])
    s.begin()
    s.put("t", dml.delete(s.tables["t"], F.col("id") == 1), "delete")
    s.savepoint("p")
    s.put("t", dml.delete(s.tables["t"], F.lit(True)), "delete")
    s.rollback_to("p")
    assert s.tables["t"].count() == 1
    s.rollback()
    assert s.tables["t"].count() == 2
    assert s.nextval("q") == 1 and s.nextval("q") == 2 and s.setval("q", 9) == 9 and s.currval("q") == 9
    assert s.sql("SELECT name FROM {t} WHERE id = :k", {"k": 2}).first()[0] == "b"
    s.rename_column("t", "name", "label")
    s.add_column("t", "n", "int", "7")
    assert s.tables["t"].columns == ["id", "label", "n"]
    s.drop("t")
    assert s.schema_table().count() == 0


def test_merge_refuses_double_matches(spark):
    t = spark.createDataFrame([(1, 1)], "k int, v int")
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ConstraintError):
        dml.merge(t, twice, ["k"], [dml.When(True, "update", {"v": "s.v"})])


def test_recursion_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    hop = edges.selectExpr("a AS m", "b AS c")
    found = recursive_union(edges.where("a = 1"), lambda new: new.join(hop, F.col("b") == F.col("m")).selectExpr("a", "c AS b"))
    assert sorted(r.b for r in found.collect()) == [1, 2, 3]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = load(spark, sf_dir, "events")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.read_stream(spark, str(tmp_path / "in"), rows.schema, 1), "1 day", late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbled")) == key(events.tumbling(rows, "1 day"))


def test_entry_without_the_optional_part(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("marlpit.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 100 and "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q)
assert set(o) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_rows_without_a_key_all_stay(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(None, "b"), (None, "c"), (1, "d"), (2, "e"), (2, "f")], "k int, v string")
    ordered = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert ordered(dml.insert_or_ignore(t, rows, ["k"], F.col("v"))) == [(1, "a"), (2, "e"), (None, "b"), (None, "c")]
    assert ordered(dml.insert_or_replace(t, rows, ["k"], F.col("v"))) == [(1, "d"), (2, "f"), (None, "b"), (None, "c")]
    assert ordered(dml.upsert(t, rows, ["k"], {"v": "s.v"}, F.col("v"))) == [(1, "d"), (2, "f"), (None, "b"), (None, "c")]
    assert ordered(dml.upsert(t, rows, ["k"], None, F.col("v"))) == [(1, "a"), (2, "e"), (None, "b"), (None, "c")]


def test_percentiles_and_ranks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = {"a": np.round(rng.normal(0, 1, 20_001), 2), "b": np.zeros(7), "c": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("d", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (0.0, 0.37, 0.5, 1.0):
        got = {r.g: r.q for r in aggregates.percentile_per_group(df, ["g"], "x", p, "q", 100).collect()}
        assert set(got) == {"a", "b", "c", "d", None} and got["d"] is None and got[None] == 3.0
        assert all(abs(got[g] - np.quantile(xs, p)) < 1e-9 for g, xs in values.items())
    ranks = {(r.x, r.r) for r in windows.rank_over_all(df, "x", "r", descending=True).collect()}
    wanted = sorted((x for _, x in rows if x is not None), reverse=True)
    assert ranks == {(x, wanted.index(x) + 1) for x in set(wanted)} | {(None, len(wanted) + 1)}
