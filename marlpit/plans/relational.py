"""Scans, filters, joins, aggregates, windows, sorting, set operations and CTEs as queries over the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.functions import strings
from marlpit.operators import aggregates, windows
from marlpit.operators.recursion import recursive_union
from marlpit.sources.tables import generate_series, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Doubles are rounded alike on both sides, halves away from zero.
R2 = "sign({0}) * floor(abs({0}) * 100 + 0.5) / 100"


def r2(x: str) -> str:
    return R2.format(x)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in SQL, {table} standing for a test table; the oracle is the same text unless given."""
    tables = set(re.findall(r"\{([a-z]+)\}", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{([a-z]+)\}", r"\1", oracle or text)


def frame(name: str, oracle: str | None):
    """Register a function (load, spark) -> DataFrame, with load(name) reading a test table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: load(spark, sf_dir, t), spark)
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- scan and filter ---

sql("scan_project", "SELECT p_partkey, p_name, p_size * 2 AS double_size FROM {part}")
sql("filter_between", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000")
sql("filter_in_list", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_nationkey IN (1, 3, 5, 7)")
sql("filter_range_time", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'", )
sql("is_distinct_from", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE nullif(l_linenumber, 1) IS DISTINCT FROM nullif(l_linenumber, 2)")
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status_no FROM {orders}")
sql("null_logic", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE NOT (nullif(l_linenumber, 1) > 2 AND nullif(l_linenumber, 3) < 5)")
sql("arithmetic_int", "SELECT o_orderkey, try_divide(o_orderkey, o_custkey % 7) AS ratio, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey div nullif(o_custkey % 7, 0) END AS quotient, o_orderkey % 7 AS rest FROM {orders}",
    "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey / (o_custkey % 7) END AS ratio, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey // (o_custkey % 7) END AS quotient, o_orderkey % 7 AS rest FROM orders")
sql("count_range", "SELECT count(*) AS n FROM {orders} WHERE o_orderkey BETWEEN 100 AND 5000")


@frame("filter_like_ci", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%e%'")
def _(t, spark):
    return t("part").where(strings.like(F.col("p_name"), "%A%e%")).select("p_partkey", "p_name")


@frame("filter_like_escape", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_%' ESCAPE '#'")
def _(t, spark):
    return t("part").where(strings.like(F.col("p_brand"), "Brand#_%", "#")).select("p_partkey")


@frame("filter_glob", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB '*[1-3]?'")
def _(t, spark):
    return t("part").where(strings.glob(F.col("p_brand"), "*[1-3]?")).select("p_partkey", "p_brand")


sql("filter_regexp", "SELECT c_custkey, c_name FROM {customer} WHERE c_name RLIKE '0{{2}}[1-4]+$'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '0{2}[1-4]+$')")


@frame("filter_similar_to", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO '.*(1|2)(3|4)'")
def _(t, spark):
    return t("part").where(strings.similar_to(F.col("p_brand"), "%(1|2)(3|4)")).select("p_partkey")


@frame("filter_match", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'st')")
def _(t, spark):
    p = t("part")
    return p.where(strings.match("ST", p.p_name, p.p_type)).select("p_partkey")


@frame("cast_prefix_int", "SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(substr(p_brand, 7), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS n, coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) AS zero FROM part")
def _(t, spark):
    return t("part").select("p_partkey", strings.cast_integer(F.expr("substr(p_brand, 7)")).alias("n"), strings.cast_integer(F.col("p_brand")).alias("zero"))


# --- joins ---

sql("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 300000")
sql("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sql("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey - 50")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")


@frame("join_theta_range", "SELECT s_suppkey, c_custkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > s_acctbal")
def _(t, spark):
    # few nations and many pairs: customers are dealt into parts, each joined with a copy of the suppliers, so that all tasks have work
    parts, cores = 32, spark.sparkContext.defaultParallelism
    nations = F.broadcast(t("nation").select("n_nationkey"))
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).cast("int")
    customers = t("customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("n_nationkey"), part.alias("part"))
    suppliers = t("supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    suppliers = suppliers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left, right = (x.repartition(8 * cores, "n_nationkey", "part") for x in (customers, suppliers))
    return left.join(right.hint("shuffle_hash"), ["n_nationkey", "part"]).where("c_acctbal > s_acctbal").select("s_suppkey", "c_custkey")


sql("join_using", "WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey), b AS (SELECT o_orderkey AS k, o_custkey FROM {orders}) SELECT k, q, o_custkey FROM a JOIN b USING (k)")
sql("join_natural", "WITH a AS (SELECT n_nationkey AS k, n_name FROM {nation}), b AS (SELECT s_nationkey AS k, s_name FROM {supplier}) SELECT k, n_name, s_name FROM a NATURAL JOIN b")
sql("join_comma_where", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
sql("join_multi_5way", f"SELECT r_name, count(*) AS n, {r2('sum(l_extendedprice * (1 - l_discount))')} AS revenue FROM {{region}} JOIN {{nation}} ON n_regionkey = r_regionkey JOIN {{customer}} ON c_nationkey = n_nationkey JOIN {{orders}} ON o_custkey = c_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey GROUP BY r_name")
sql("semi_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql("anti_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
sql("in_subquery", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")
sql("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})")
sql("in_tuple", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM {orders} WHERE o_orderstatus = 'F')")
sql("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top_price FROM {customer}")


@frame("lateral_top1", "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o")
def _(t, spark):
    # the best order of each customer by a partial aggregate; a lateral join would repeat the search for every row
    best = t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("o_orderkey"))
    return t("customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


# --- aggregates ---

sql("agg_flagship", f"SELECT l_returnflag, l_linestatus, {r2('sum(l_quantity)')} AS sum_qty, {r2('sum(l_extendedprice)')} AS sum_base, {r2('sum(l_extendedprice * (1 - l_discount))')} AS sum_disc, {r2('avg(l_quantity)')} AS avg_qty, count(*) AS n FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM {orders} WHERE o_orderkey < 0")
sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey, o_orderpriority) AS pairs FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs FROM orders GROUP BY o_orderstatus")
sql("agg_filter", f"SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, {r2('sum(l_extendedprice) FILTER (WHERE l_linenumber = 1)')} AS firsts FROM {{lineitem}} GROUP BY l_returnflag")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_expression_key", "SELECT o_orderkey % 10 AS k, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM {orders} GROUP BY o_orderkey % 10")
sql("rollup", f"SELECT l_returnflag, l_linestatus, {r2('sum(l_quantity)')} AS q FROM {{lineitem}} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("grouping_fn", "SELECT o_orderstatus, CAST(grouping(o_orderstatus) AS BIGINT) AS g, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus)")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")


@frame("agg_total", f"SELECT l_returnflag, coalesce({r2('sum(CAST(nullif(l_linenumber, 1) AS DOUBLE))')}, 0.0) AS total, coalesce(sum(CAST(NULL AS DOUBLE)), 0.0) AS nothing FROM lineitem GROUP BY l_returnflag")
def _(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(aggregates.total(F.expr("nullif(l_linenumber, 1)")).alias("total"), aggregates.total(F.lit(None).cast("double")).alias("nothing"))


@frame("agg_median", "SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag")
def _(t, spark):
    return aggregates.percentile_per_group(t("lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, "m")


@frame("agg_percentile_cont", f"SELECT o_orderstatus, {r2('quantile_cont(o_totalprice, 0.9)')} AS p90 FROM orders GROUP BY o_orderstatus")
def _(t, spark):
    p90 = aggregates.percentile_per_group(t("orders"), ["o_orderstatus"], "o_totalprice", 0.9, "p")
    return p90.selectExpr("o_orderstatus", f"{r2('p')} AS p90")


@frame("agg_group_concat_ordered", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(aggregates.group_concat(F.col("n_name"), "; ").alias("names"))


@frame("agg_json_group_array", "SELECT o_custkey, '[' || string_agg(coalesce(CAST(nullif(o_orderkey % 5, 0) AS VARCHAR), 'null'), ',' ORDER BY o_orderkey) || ']' AS doc FROM orders GROUP BY o_custkey")
def _(t, spark):
    return t("orders").groupBy("o_custkey").agg(aggregates.json_group_array(F.expr("nullif(o_orderkey % 5, 0)"), F.col("o_orderkey")).alias("doc"))


@frame("agg_json_group_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) || '}' AS doc FROM nation GROUP BY n_regionkey")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(aggregates.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("doc"))


@frame("bare_columns", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def _(t, spark):
    return aggregates.first_of_group(t("orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], F.col("o_orderkey"))


@frame("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(t, spark):
    return aggregates.distinct_on(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


# --- windows ---

_OVER = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST"
sql("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER ({_OVER}) AS BIGINT) AS rn FROM {{orders}}")
sql("win_rank_dense", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity NULLS FIRST) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity NULLS FIRST) AS BIGINT) AS d FROM {lineitem}")
sql("win_percent_cume", "SELECT o_orderkey, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS FIRST) AS p, cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS FIRST) AS c FROM {orders}")
sql("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) OVER ({_OVER}) AS BIGINT) AS bucket FROM {{orders}}")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER ({_OVER}) AS before, lead(o_orderkey, 2) OVER ({_OVER}) AS after FROM {{orders}}")
sql("win_first_last_nth", f"SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS second FROM {{orders}} WINDOW w AS ({_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("win_rows_frame", f"SELECT o_orderkey, {r2(f'sum(o_totalprice) OVER ({_OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS s, count(*) OVER ({_OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM {{orders}}")
sql("win_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM {lineitem}", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem")
sql("win_named", f"SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, max(o_totalprice) OVER w AS m FROM {{orders}} WINDOW w AS ({_OVER})")


@frame("win_over_groups", "SELECT o_custkey, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) g")
def _(t, spark):
    return windows.rank_over_all(t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", "r", descending=True)


@frame("win_groups_frame", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER w AS n, max(l_linenumber) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def _(t, spark):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return windows.groups_frame(rows, ["l_orderkey"], "l_quantity", 1, 1, n=F.count("*"), m=F.max("l_linenumber"))


def _exclude(kind: str):
    short = "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING" if kind == "current row" else "ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    total = r2(f"sum(o_totalprice) OVER (PARTITION BY o_custkey {short} EXCLUDE {kind.upper()})")

    @frame(f"win_exclude_{kind.replace(' ', '_')}", f"SELECT o_orderkey, {total} AS s FROM orders")
    def _(t, spark):
        w = Window.partitionBy("o_custkey")
        if kind == "current row":
            w = w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 2)
            found = windows.sum_excluding("o_totalprice", "o_orderkey", w, kind)
        else:
            found = windows.sum_excluding_peers("o_totalprice", ["o_custkey"], "o_orderpriority", kind == "ties")
        return t("orders").select("o_orderkey", found.alias("x")).selectExpr("o_orderkey", f"{r2('x')} AS s")


for _kind in ("current row", "group", "ties"):
    _exclude(_kind)


@frame("win_total", f"SELECT o_orderkey, coalesce({r2(f'sum(o_totalprice) OVER ({_OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')}, 0.0) AS t FROM orders")
def _(t, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-3, -1)
    return t("orders").select("o_orderkey", windows.total_over(F.col("o_totalprice"), w).alias("s")).selectExpr("o_orderkey", f"{r2('s')} AS t")


# --- sort and limit ---

sql("order_nulls", "SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 2) AS k FROM {lineitem} ORDER BY k DESC NULLS LAST, l_orderkey, l_linenumber")
sql("order_nulls_all", "SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 2) AS k FROM {lineitem} ORDER BY k DESC NULLS LAST, l_orderkey, l_linenumber")
sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_offset", "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey LIMIT 20 OFFSET 40")
sql("fetch_first", "SELECT p_partkey FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 10", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 10 ROWS ONLY")


@frame("order_collate_nocase", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey")
def _(t, spark):
    return t("part").select("p_partkey", "p_name").orderBy(strings.ascii_lower(F.col("p_name")), "p_partkey")


@frame("order_collate_nocase_all", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey")
def _(t, spark):
    return t("part").select("p_partkey", "p_name").orderBy(strings.ascii_lower(F.col("p_name")), "p_partkey")


# --- set operations and CTEs ---

sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
sql("compound_left_assoc", "(SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM {nation} WHERE n_nationkey > 20) INTERSECT SELECT s_nationkey FROM {supplier}")
sql("values", "SELECT a, b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS v(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
sql("cte_multi", "WITH o AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), c AS (SELECT c_custkey, c_nationkey FROM {customer}) SELECT c_nationkey, sum(n) AS orders FROM o JOIN c ON o_custkey = c_custkey GROUP BY c_nationkey", "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS orders FROM o JOIN c ON o_custkey = c_custkey GROUP BY c_nationkey")
sql("cte_recursive_counter", "WITH RECURSIVE c(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 15) SELECT n, f FROM c")


@frame("cte_recursive_union_graph", "WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, CAST((s_nationkey * 7 + 3) % 25 AS INTEGER) AS b FROM supplier), r AS (SELECT a, b FROM e WHERE a < 5 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def _(t, spark):
    edges = t("supplier").selectExpr("s_nationkey AS a", "CAST((s_nationkey * 7 + 3) % 25 AS INT) AS b").distinct()
    hop = edges.selectExpr("a AS m", "b AS c")
    return recursive_union(edges.where("a < 5"), lambda new: new.join(hop, F.col("b") == F.col("m")).selectExpr("a", "c AS b"))


@frame("generate_series", "SELECT generate_series AS value FROM generate_series(3, 999, 4)")
def _(t, spark):
    return generate_series(spark, 3, 999, 4)
