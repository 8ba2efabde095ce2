"""The rest of the surface as queries: user-defined functions, JSON table functions, catalogue frames, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.functions import arrays, json_text, maths, register
from marlpit.plans import relational
from marlpit.session import Session, TableMeta
from marlpit.sources.tables import values

QUERIES: dict = {}
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


def sql(name: str, text: str, oracle: str | None = None) -> None:
    relational.sql(name, text, oracle)
    QUERIES[name], ORACLES[name] = relational.QUERIES.pop(name), relational.ORACLES.pop(name)


sql("is_true_unknown", "SELECT l_orderkey, l_linenumber, (nullif(l_linenumber, 1) > 2) IS TRUE AS t, (nullif(l_linenumber, 1) > 2) IS NOT FALSE AS f, (nullif(l_linenumber, 1) > 2) IS NULL AS u FROM {lineitem}")
sql("between_null_bound", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE NOT (l_linenumber BETWEEN 3 AND nullif(l_linenumber, l_linenumber))")
sql("rowid_get", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = 77")
sql("from_less", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy")
sql("derived_table", "SELECT k, n FROM (SELECT o_custkey % 3, count(*) FROM {orders} GROUP BY o_custkey % 3) AS t(k, n)")
sql("correlated_count", "SELECT c_custkey FROM {customer} WHERE (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) > 14")
sql("any_array", "SELECT c_custkey FROM {customer} WHERE array_contains(array(1, 4, 9), c_nationkey)", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY ([1, 4, 9])")
sql("current_frame_total", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}")
sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")


@frame("udf_scalar", "SELECT p_partkey, p_size * 3 + 1 AS y FROM part")
def _(t, spark):
    f = register.scalar(spark, "mp_triple", lambda x: x * 3 + 1, "int")
    return t("part").select("p_partkey", f("p_size").alias("y"))


@frame("udaf_group", "SELECT n_regionkey, max(length(n_name)) AS longest FROM nation GROUP BY n_regionkey")
def _(t, spark):
    f = register.aggregate(spark, "mp_longest", lambda x: int(x.str.len().max()), "bigint")
    return t("nation").groupBy("n_regionkey").agg(f("n_name").alias("longest"))


@frame("udtf_rows", "SELECT unnest(generate_series(1, 4)) AS i, unnest(generate_series(1, 4)) * 10 AS ten")
def _(t, spark):
    class Tens:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield i, i * 10

    register.table_function(spark, "mp_tens", Tens, "i bigint, ten bigint")
    return spark.sql("SELECT i, ten FROM mp_tens(4)")


@frame("collation_group", "SELECT lower(rtrim(p_type)) AS k, count(*) AS n FROM part GROUP BY 1")
def _(t, spark):
    return t("part").groupBy(register.nocase(register.rtrim(F.col("p_type"))).alias("k")).agg(F.count("*").alias("n"))


@frame("json_object_keys", "SELECT event_id, 'k' AS key FROM events")
def _(t, spark):
    return json_text.object_keys(t("events").select("event_id", "props"), "props").select("event_id", "key")


@frame("json_to_record", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS z FROM events")
def _(t, spark):
    return json_text.to_record(t("events").select("event_id", "props"), "props", "k bigint, z string").drop("props")


@frame("json_path_query", "SELECT n_nationkey, unnest(['1', n_name]) AS value FROM nation")
def _(t, spark):
    inner = json_text.object_(a=F.lit(1))
    doc = F.concat(F.lit('{"items":[{"v":1},{"v":'), json_text.quote(F.col("n_name")), F.lit("},"), inner, F.lit("]}"))
    return json_text.path_query(t("nation").select("n_nationkey", doc.alias("doc")), "doc", "$.items[*].v").select("n_nationkey", "value")


@frame("json_path_exists", "SELECT event_id, true AS yes, false AS no FROM events")
def _(t, spark):
    return t("events").select("event_id", json_text.path_exists(F.col("props"), "$.k").alias("yes"), json_text.path_exists(F.col("props"), "$.q").alias("no"))


@frame("array_functions", "SELECT n_nationkey, [n_nationkey, 7] AS a, CAST(2 AS BIGINT) AS n, true AS held, list_has_any([n_nationkey, 7], [1, 2]) AS shared FROM nation")
def _(t, spark):
    a = F.array("n_nationkey", F.lit(7))
    return t("nation").select("n_nationkey", a.alias("a"), F.size(a).cast("bigint").alias("n"), arrays.contained(a, F.array(F.lit(7))).alias("held"), arrays.overlap(a, F.array(F.lit(1), F.lit(2))).alias("shared"))


@frame("view_scan", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("c", t("customer"))
    s.create_view("rich", "SELECT c_nationkey, count(*) AS n FROM {c} WHERE c_acctbal > 0 GROUP BY c_nationkey")
    return s.view("rich")


@frame("index_list", "SELECT 0 AS seq, 'by_key' AS name, 1 AS \"unique\", 'r_regionkey' AS columns")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("region", t("region"))
    s.create_index("by_key", "region", ["r_regionkey"], unique=True)
    return s.index_list("region")


@frame("foreign_key_list", "SELECT 0 AS id, 'region' AS \"table\", 'n_regionkey' AS \"from\", 'r_regionkey' AS \"to\"")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("region", t("region"))
    s.create("nation", t("nation"), TableMeta(foreign_keys=[("n_regionkey", "region", "r_regionkey")]))
    return s.foreign_key_list("nation")


@frame("schema_table", "SELECT 'table' AS type, 'region' AS name, 'r_regionkey int, r_name string' AS columns")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("region", t("region"))
    return s.schema_table()


@frame("analyze_statistics", "SELECT 'n_nationkey' AS \"column\", count(*) AS n, count(DISTINCT n_nationkey) AS \"distinct\", CAST(0 AS BIGINT) AS nulls, min(CAST(n_nationkey AS VARCHAR)) AS low, max(CAST(n_nationkey AS VARCHAR)) AS high FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(DISTINCT n_regionkey), 0, min(CAST(n_regionkey AS VARCHAR)), max(CAST(n_regionkey AS VARCHAR)) FROM nation")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("nation", t("nation").select("n_nationkey", "n_regionkey"))
    return s.statistics("nation")


@frame("integrity_check", "SELECT 'c' AS \"table\", 'c: small fails' AS message")
def _(t, spark):
    s = Session(spark, configure=False)
    s.create("c", t("customer"))
    s.create("r", t("region"), TableMeta(primary_key=["r_regionkey"]))
    s.meta["c"].checks["small"] = "c_custkey < 3"
    return s.integrity_check()


@frame("sequence_values", "SELECT CAST(100 + row_number() OVER (ORDER BY n_name) AS BIGINT) AS id, n_name FROM nation")
def _(t, spark):
    s = Session(spark, configure=False)
    s.setval("ids", 100)
    return s.nextvals("ids", t("nation").select("n_name"), "id", [F.col("n_name")]).select("id", "n_name")


@frame("inline_values", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL)) AS v(k, x)")
def _(t, spark):
    return values(spark, [(1, "a"), (2, None)], "k bigint, x string")


@frame("fn_random", None)
def _(t, spark):
    return t("nation").select("n_nationkey", maths.random().alias("r"), F.uuid().alias("u"))
