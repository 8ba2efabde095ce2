"""Row changes, constraints, the JSON query tree, streams and sources as queries: each returns a final table state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import dml
from marlpit.plans import ir, relational
from marlpit.plans.relational import r2
from marlpit.session import Session, TableMeta, shared_folder
from marlpit.sources import tables
from marlpit.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def frame(name: str, oracle: str | None):
    add = relational.frame(name, oracle)

    def moved(f):
        add(f)
        QUERIES[name] = relational.QUERIES.pop(name)
        if oracle:
            ORACLES[name] = relational.ORACLES.pop(name)
        return f

    return moved


_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _new_customers(t) -> DataFrame:
    """Every third customer with a changed balance, and as many new ones."""
    old = t("customer").where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000)
    return old.unionByName(old.withColumn("c_custkey", F.col("c_custkey") + 1_000_000).withColumn("c_name", F.lit("new")))


_NEW = f"SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 'new', c_nationkey, c_acctbal + 1000, c_mktsegment FROM customer WHERE c_custkey % 3 = 0"


@frame("dml_insert", f"SELECT {_C} FROM customer UNION ALL SELECT s_suppkey + 5000000, s_name, s_nationkey, s_acctbal, NULL FROM supplier")
def _(t, spark):
    rows = t("supplier").selectExpr("s_suppkey + 5000000 AS c_custkey", "s_name AS c_name", "s_nationkey AS c_nationkey", "s_acctbal AS c_acctbal")
    return dml.insert(t("customer"), rows)


@frame("dml_insert_row_ids", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier")
def _(t, spark):
    table = t("customer").selectExpr("c_custkey AS id", "c_name AS name")
    rows = dml.with_row_ids(table, t("supplier").selectExpr("s_suppkey AS k", "s_name AS name"), "id", [F.col("k")], 8)
    return dml.insert(table, rows)


@frame("dml_update", f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t, spark):
    return dml.update(t("customer"), F.expr("c_mktsegment = 'BUILDING' AND c_acctbal < 0"), {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("CLOSED")})


@frame("dml_update_from", f"SELECT c_custkey, c_name, c_nationkey, coalesce(p, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(t, spark):
    best = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("p"))
    return dml.merge(t("customer"), best, ["c_custkey"], [dml.When(True, "update", {"c_acctbal": "s.p"})])


@frame("dml_delete", f"SELECT {_C} FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 20, false)")
def _(t, spark):
    return dml.delete(t("customer"), F.expr("nullif(c_nationkey, 3) > 20"))


@frame("dml_delete_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 100)")
def _(t, spark):
    gone = dml.limited(t("orders"), F.expr("o_orderstatus = 'O'"), [F.col("o_totalprice"), F.col("o_orderkey")], 100, ["o_orderkey"])
    return t("orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@frame("dml_upsert", f"WITH n AS ({_NEW}) SELECT c.c_custkey, c.c_name, c.c_nationkey, CASE WHEN n.c_custkey IS NOT NULL AND c.c_acctbal > 0 THEN n.c_acctbal ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN n USING (c_custkey) UNION ALL SELECT {_C} FROM n WHERE c_custkey >= 1000000")
def _(t, spark):
    return dml.upsert(t("customer"), _new_customers(t), ["c_custkey"], {"c_acctbal": "s.c_acctbal"}, F.col("c_acctbal"), "t.c_acctbal > 0")


@frame("dml_insert_or_ignore", f"WITH n AS ({_NEW}) SELECT {_C} FROM customer UNION ALL SELECT {_C} FROM n WHERE c_custkey >= 1000000")
def _(t, spark):
    return dml.insert_or_ignore(t("customer"), _new_customers(t), ["c_custkey"], F.col("c_acctbal"))


@frame("dml_replace", f"WITH n AS ({_NEW}) SELECT {_C} FROM n UNION ALL SELECT {_C} FROM customer WHERE c_custkey % 3 <> 0")
def _(t, spark):
    return dml.insert_or_replace(t("customer"), _new_customers(t), ["c_custkey"], F.col("c_acctbal"))


@frame("dml_merge", f"WITH n AS ({_NEW}) SELECT {_C} FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c.c_custkey, c.c_name, c.c_nationkey, n.c_acctbal, c.c_mktsegment FROM customer c JOIN n USING (c_custkey) WHERE c.c_acctbal >= 0 UNION ALL SELECT {_C} FROM n WHERE c_custkey >= 1000000 AND c_nationkey < 10")
def _(t, spark):
    return dml.merge(
        t("customer"),
        _new_customers(t),
        ["c_custkey"],
        [
            dml.When(True, "delete", condition="t.c_acctbal < 0"),
            dml.When(True, "update", {"c_acctbal": "s.c_acctbal"}),
            dml.When(False, "insert", {c.strip(): f"s.{c.strip()}" for c in _C.split(",")}, "s.c_nationkey < 10"),
        ],
    )


@frame("dml_returning", "SELECT c_custkey, 0.0 AS c_acctbal FROM customer WHERE c_acctbal < 0".replace("0.0 AS", "CAST(0 AS DOUBLE) AS"))
def _(t, spark):
    return dml.returning(t("customer"), F.expr("c_acctbal < 0"), {"c_acctbal": F.lit(0.0)}, [F.col("c_custkey"), F.col("c_acctbal")])


@frame("dml_upsert_repeats", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 2, 'again' FROM customer WHERE c_custkey % 2 = 1")
def _(t, spark):
    # every odd key is new and proposed twice: the first row is inserted, the second updates it
    c = t("customer")
    odd = c.where("c_custkey % 2 = 1")
    rows = odd.withColumn("n", F.lit(1)).unionByName(odd.withColumn("n", F.lit(2)).withColumn("c_acctbal", F.col("c_acctbal") + 2).withColumn("c_name", F.lit("unused")))
    return dml.upsert(c.where("c_custkey % 2 = 0"), rows, ["c_custkey"], {"c_acctbal": "s.c_acctbal", "c_mktsegment": "'again'"}, F.col("n"))


@frame("dml_insert_or_ignore_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, CAST(NULL AS INTEGER) FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey = 3 UNION ALL SELECT min(c_custkey), c_nationkey FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey <> 3 AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY c_nationkey")
def _(t, spark):
    # unique on c_nationkey: rows without one never conflict
    c = t("customer").selectExpr("c_custkey", "nullif(c_nationkey, 3) AS c_nationkey")
    return dml.insert_or_ignore(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), ["c_nationkey"], F.col("c_custkey"))


@frame("dml_upsert_arms", "SELECT c_custkey, CASE WHEN c_custkey <= 20 THEN 'by key' WHEN c_custkey <= 40 THEN 'by name' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 9000000, c_name || ' new' FROM customer WHERE c_custkey BETWEEN 41 AND 60")
def _(t, spark):
    c = t("customer").select("c_custkey", "c_name")
    rows = c.where("c_custkey <= 20").withColumn("c_name", F.concat("c_name", F.lit("?")))
    rows = rows.unionByName(c.where("c_custkey between 21 and 40").withColumn("c_custkey", F.col("c_custkey") + 8_000_000))
    rows = rows.unionByName(c.where("c_custkey between 41 and 60").selectExpr("c_custkey + 9000000 AS c_custkey", "c_name || ' new' AS c_name"))
    return dml.upsert_arms(c, rows, [(["c_custkey"], {"c_name": "'by key'"}), (["c_name"], {"c_name": "'by name'"})], F.col("c_custkey"))


@frame("dml_update_limit", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t, spark):
    return dml.update_limited(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.expr("o_orderstatus = 'O'"), {"o_orderstatus": F.lit("X")}, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@frame("dml_insert_returning", "SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id, upper(s_name) AS name FROM supplier")
def _(t, spark):
    table = t("customer").selectExpr("c_custkey AS id", "c_name AS name")
    rows = dml.with_row_ids(table, t("supplier").selectExpr("s_suppkey AS k", "s_name AS name"), "id", [F.col("k")], 8)
    return dml.aligned(rows, table).select("id", F.upper("name").alias("name"))


@frame("dml_delete_returning", "SELECT c_custkey, -c_acctbal AS owed FROM customer WHERE c_acctbal < 0")
def _(t, spark):
    return t("customer").where("c_acctbal < 0").select("c_custkey", (-F.col("c_acctbal")).alias("owed"))


@frame("fk_restrict", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t, spark):
    return dml.restricted(t("orders"), "o_custkey", t("customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@frame("fk_set_default", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def _(t, spark):
    return dml.cascade_set(t("orders"), "o_custkey", t("customer").where("c_acctbal < 0"), "c_custkey", F.lit(1).cast("bigint")).select("o_orderkey", "o_custkey")


@frame("row_trigger_audit", "SELECT c_custkey, c_acctbal AS before, CAST(0 AS DOUBLE) AS after FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def _(t, spark):
    # AFTER UPDATE OF c_acctbal WHEN old <> new, as a set: the changed rows beside what they were
    old = t("customer")
    new = dml.update(old, F.expr("c_mktsegment = 'BUILDING' AND c_acctbal < 0"), {"c_acctbal": F.lit(0.0)})
    both = old.select("c_custkey", F.col("c_acctbal").alias("before")).join(new.select("c_custkey", F.col("c_acctbal").alias("after")), "c_custkey")
    return both.where("before <> after").select("c_custkey", "before", "after")


@frame("savepoint_rollback_to", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer WHERE c_custkey % 2 = 0")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("c", t("customer"))
    s.begin()
    s.put("c", dml.delete(s.tables["c"], F.expr("c_custkey % 2 = 1")), "delete")
    s.savepoint("half")
    s.put("c", dml.delete(s.tables["c"], F.lit(True)), "delete")
    s.rollback_to("half")
    s.release("half")
    s.commit()
    return s.sql("SELECT count(*) AS n, sum(c_custkey) AS s FROM {c}")


@frame("alter_table", "SELECT s_suppkey AS id, s_name, 'none' AS note FROM supplier")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("s", t("supplier"))
    s.rename_column("s", "s_suppkey", "id")
    s.add_column("s", "note", "string", "'none'")
    s.drop_column("s", "s_acctbal")
    s.drop_column("s", "s_nationkey")
    s.rename("s", "suppliers")
    return s.tables["suppliers"]


@frame("ctas", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("customer", t("customer"))
    s.create("per_nation", s.sql("SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey"))
    return s.tables["per_nation"]


@frame("transaction_rollback", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer WHERE c_custkey % 2 = 0")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("c", t("customer"), TableMeta(primary_key=["c_custkey"], not_null=["c_name"], checks={"nation": "c_nationkey between 0 and 24"}))
    s.put("c", dml.delete(s.tables["c"], F.expr("c_custkey % 2 = 1")), "delete")
    s.begin()
    s.put("c", dml.delete(s.tables["c"], F.lit(True)), "delete")
    s.rollback()
    return s.sql("SELECT count(*) AS n, sum(c_custkey) AS s FROM {c}")


@frame("generated_column", "SELECT p_partkey, p_retailprice * p_size AS worth FROM part")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("part", t("part").select("p_partkey", "p_size", "p_retailprice"), TableMeta(generated={"worth": "p_retailprice * p_size"}))
    return s.tables["part"].select("p_partkey", "worth")


@frame("fk_check", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t, spark):
    return dml.orphans(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus = 'F'"), "o_orderkey").select("l_orderkey", "l_linenumber")


@frame("fk_cascade", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t, spark):
    return dml.cascade_delete(t("orders"), "o_custkey", t("customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@frame("fk_set_null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def _(t, spark):
    return dml.cascade_set_null(t("orders"), "o_custkey", t("customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey", "o_custkey")


@frame("table_info", "SELECT * FROM (VALUES (0, 'r_regionkey', 'int', 1, CAST(NULL AS VARCHAR), 1), (1, 'r_name', 'string', 0, NULL, 0)) AS v(cid, name, type, \"notnull\", dflt_value, pk)")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("region", t("region"), TableMeta(primary_key=["r_regionkey"], not_null=["r_regionkey"]))
    return s.table_info("region")


@frame("attach_cross_db", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("nation", t("nation"))
    s.tables["other_region"] = t("region")
    return s.sql("SELECT n_name, r_name FROM {nation} JOIN {other_region} ON n_regionkey = r_regionkey")


# --- the JSON query tree ---

_TREE = {
    "from": "orders",
    "joins": [{"table": "customer", "kind": "inner", "on": {"op": "eq", "args": [{"col": "o_custkey"}, {"col": "c_custkey"}]}}],
    "where": {"op": "and", "args": [{"op": "gt", "args": [{"col": "o_totalprice"}, {"lit": 1000.0}]}, {"in": [{"col": "o_orderstatus"}, ["F", "O"]]}]},
    "group_by": {"segment": {"col": "c_mktsegment"}},
    "select": {"n": {"agg": "count"}, "top": {"agg": "max", "arg": {"col": "o_totalprice"}}, "big": {"agg": "count", "arg": {"lit": 1}, "filter": {"op": "gt", "args": [{"col": "o_totalprice"}, {"lit": 200000.0}]}}},
    "having": {"op": "gt", "args": [{"col": "n"}, {"lit": 10}]},
    "order_by": [["segment", "asc"]],
}


@frame("ir_select_join_group", "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS top, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY c_mktsegment HAVING count(*) > 10")
def _(t, spark):
    return ir.query(_TREE, {n: t(n) for n in ("orders", "customer")})


@frame("ir_semi_case_limit", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'fine' END AS state FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_custkey LIMIT 50 OFFSET 5")
def _(t, spark):
    tree = {
        "from": "customer",
        "joins": [{"table": {"from": "orders", "where": {"op": "eq", "args": [{"col": "o_orderstatus"}, {"lit": "P"}]}}, "kind": "semi", "on": {"op": "eq", "args": [{"col": "c_custkey"}, {"col": "o_custkey"}]}}],
        "select": {"c_custkey": {"col": "c_custkey"}, "state": {"case": [[{"op": "lt", "args": [{"col": "c_acctbal"}, {"lit": 0.0}]}, {"lit": "low"}]], "else": {"lit": "fine"}}},
        "order_by": [["c_custkey", "asc"]],
        "limit": 50,
        "offset": 5,
    }
    return ir.query(tree, {n: t(n) for n in ("orders", "customer")})


# --- sources, streams ---


@frame("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t, spark):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write(t("supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "csv")
    return tables.read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@frame("output_modes", "SELECT n_nationkey || '|' || n_name AS line FROM nation UNION ALL SELECT 'INSERT INTO t VALUES(' || n_nationkey || ',''' || n_name || ''');' FROM nation UNION ALL SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' FROM nation")
def _(t, spark):
    rows = t("nation").select("n_nationkey", "n_name")
    return tables.rendered(rows).unionAll(tables.rendered(rows, "insert")).unionAll(tables.rendered(rows, "json"))


@frame("stream_tumbling", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {r2('sum(value)')} AS total FROM events GROUP BY ALL")
def _(t, spark):
    return events.tumbling(t("events"), "1 hour").selectExpr("start", "event_type", "n", f"{r2('total')} AS total")


@frame("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t, spark):
    return events.sessions(t("events"), "2 hours")


@frame("cdc_apply", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN 'changed' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT s_suppkey + 7000000, s_name FROM supplier")
def _(t, spark):
    # keys of 0 modulo 5 are changed, then deleted; of 1 modulo 5, deleted, then written again; suppliers are new
    c = t("customer").select("c_custkey", "c_name")
    change = lambda where, op, seq, name="c_name": c.where(where).select("c_custkey", F.expr(name).alias("c_name"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    changes = change("c_custkey % 5 = 0", "U", 1, "'lost'").unionByName(change("c_custkey % 5 = 0", "D", 2))
    changes = changes.unionByName(change("c_custkey % 5 = 1", "D", 1)).unionByName(change("c_custkey % 5 = 1", "U", 2, "'changed'"))
    new = t("supplier").selectExpr("s_suppkey + 7000000 AS c_custkey", "s_name AS c_name", "'I' AS op", "1 AS seq")
    return events.apply_changes(c, changes.unionByName(new), ["c_custkey"])


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: windows that the watermark closes, appended to a table in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = tables.load(spark, sf_dir, "events").schema
    rows = events.read_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    found = events.tumbling(rows, "1 hour", late="2 hours")
    events.append_to(found, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(found.schema).parquet(f"{folder}/out").select("start", "event_type", "n")


QUERIES["stream_append"] = _streamed
ORACLES["stream_append"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR"
