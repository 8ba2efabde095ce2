"""Scalar, JSON, array and vector functions as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.functions import dates, json_text, maths, strings, vectors
from marlpit.plans.relational import r2
from marlpit.plans import relational

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


# --- strings ---


@frame("fn_string", "SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, CAST(length(p_name) AS BIGINT) AS n, CAST(octet_length(encode(p_name)) AS BIGINT) AS bytes, concat(p_brand, nullif(p_type, p_type), '!') AS c, concat_ws('-', p_brand, nullif(p_size, p_size), p_type) AS w, CAST(instr(p_name, 'a') AS BIGINT) AS at, replace(p_name, 'e', 'EE') AS rep, unicode(p_name) AS u FROM part")
def _(t, spark):
    c = F.col
    none = F.lit(None).cast("string")
    return t("part").select(
        "p_partkey", strings.ascii_lower(c("p_name")).alias("low"), strings.ascii_upper(c("p_name")).alias("up"), F.char_length("p_name").cast("bigint").alias("n"), F.octet_length("p_name").cast("bigint").alias("bytes"),
        strings.concat_all(c("p_brand"), none, F.lit("!")).alias("c"), F.concat_ws("-", "p_brand", none, "p_type").alias("w"), strings.instr(c("p_name"), F.lit("a")).cast("bigint").alias("at"), strings.replace(c("p_name"), F.lit("e"), F.lit("EE")).alias("rep"), strings.unicode(c("p_name")).alias("u"),
    )


@frame("fn_substr_edges", "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 1, 2) AS zero, right(p_name, 3) AS tail, substr(p_name, 3) AS rest, substr(p_name, 2, 2) AS leftward FROM part")
def _(t, spark):
    x = F.col("p_name")
    return t("part").select("p_partkey", strings.substr(x, 2, 3).alias("a"), strings.substr(x, 0, 3).alias("zero"), strings.substr(x, -3).alias("tail"), strings.substr(x, 3).alias("rest"), strings.substr(x, 4, -2).alias("leftward"))


@frame("fn_trim", "SELECT n_nationkey, trim('  ' || n_name || ' ') AS t, ltrim('xx' || n_name, 'x') AS l, rtrim(n_name || 'yzy', 'yz') AS r, trim(chr(9) || n_name) AS tab FROM nation")
def _(t, spark):
    x = F.col("n_name")
    return t("nation").select("n_nationkey", strings.trim(F.concat(F.lit("  "), x, F.lit(" "))).alias("t"), strings.ltrim(F.concat(F.lit("xx"), x), "x").alias("l"), strings.rtrim(F.concat(x, F.lit("yzy")), "yz").alias("r"), strings.trim(F.concat(F.lit("\t"), x)).alias("tab"))


@frame("fn_hex", "SELECT n_nationkey, hex(n_name) AS h, '' AS nothing, n_name AS back, chr(97 + n_nationkey) || 'é' AS ch, '''' || replace(n_name, '''', '''''') || '''' AS q FROM nation")
def _(t, spark):
    x = F.col("n_name")
    return t("nation").select("n_nationkey", strings.hex_text(x).alias("h"), strings.hex_text(F.lit(None).cast("string")).alias("nothing"), F.decode(strings.unhex_text(strings.hex_text(x)), "utf-8").alias("back"), strings.char(F.col("n_nationkey") + 97, F.lit(233)).alias("ch"), strings.quote(x).alias("q"))


@frame("fn_printf", "SELECT p_partkey, printf('%05d|%s|%.2f|%x', p_size, p_brand, p_retailprice, p_size) AS line FROM part")
def _(t, spark):
    return t("part").select("p_partkey", strings.printf("%05d|%s|%.2f|%x", F.col("p_size"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_size")).alias("line"))


@frame("fn_nullif_coalesce", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_linenumber, 1), -1) AS a, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS b, ifnull(nullif(l_returnflag, 'N'), '?') AS c FROM lineitem")
def _(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.expr("coalesce(nullif(l_linenumber, 1), -1)").alias("a"), F.expr("if(l_quantity > 25, 'big', 'small')").alias("b"), F.expr("ifnull(nullif(l_returnflag, 'N'), '?')").alias("c"))


@frame("fn_scalar_minmax", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN least(l_linenumber, 3) END AS low, CASE WHEN l_linenumber <> 1 THEN greatest(l_linenumber, 3) END AS high FROM lineitem")
def _(t, spark):
    x = F.expr("nullif(l_linenumber, 1)")
    return t("lineitem").select("l_orderkey", "l_linenumber", strings.scalar_min(x, F.lit(3)).alias("low"), strings.scalar_max(x, F.lit(3)).alias("high"))


@frame("fn_typeof", "SELECT c_custkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN c_nationkey = 3 THEN 'null' ELSE 'integer' END AS d FROM customer")
def _(t, spark):
    c = F.col
    return t("customer").select("c_custkey", strings.typeof(c("c_custkey"), "bigint").alias("a"), strings.typeof(c("c_acctbal"), "double").alias("b"), strings.typeof(c("c_name"), "string").alias("c"), strings.typeof(F.expr("nullif(c_nationkey, 3)"), "int").alias("d"))


@frame("fn_highlight", "SELECT p_partkey, regexp_replace(p_name, '(a)', '<b>\\1</b>', 'gi') AS h FROM part")
def _(t, spark):
    return t("part").select("p_partkey", strings.highlight(F.col("p_name"), "a", "<b>", "</b>").alias("h"))


@frame("fn_truthy", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS yes FROM nation")
def _(t, spark):
    text = F.expr("CASE n_nationkey % 4 WHEN 0 THEN ' True' WHEN 1 THEN 'f' WHEN 2 THEN '2.5x' ELSE 'abc' END")
    return t("nation").select("n_nationkey", strings.truthy(text).alias("yes"))


@frame("fn_cast_real", "SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5 AS r, 0.0 AS zero FROM part".replace("0.0 AS", "CAST(0 AS DOUBLE) AS"))
def _(t, spark):
    return t("part").select("p_partkey", strings.cast_real(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5xyz"))).alias("r"), strings.cast_real(F.col("p_brand")).alias("zero"))


@frame("fn_cast_uuid", "SELECT n_nationkey, '0000000' || hex(n_nationkey % 16)[-1:] || '-aaaa-bbbb-cccc-ddddddddeeee' AS u FROM nation".replace("hex(n_nationkey % 16)[-1:]", "lower(right(hex(n_nationkey % 16), 1))"))
def _(t, spark):
    digit = F.hex(F.col("n_nationkey") % 16)
    return t("nation").select("n_nationkey", strings.cast_uuid(F.concat(F.lit("{0000000"), digit, F.lit("AAAABBBBCCCCDDDDDDDDEEEE}"))).alias("u"))


# --- mathematics ---


@frame("fn_math", f"SELECT c_custkey, {r2('sqrt(abs(c_acctbal))')} AS s, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS BIGINT) AS g, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, trunc(c_acctbal) AS cut, {r2('degrees(c_nationkey)')} AS d, {r2('power(c_nationkey, 1.5)')} AS p, {r2('sin(c_nationkey) * 100')} AS sine, {r2('atan2(c_nationkey, 3) * 100')} AS at2, CAST(NULL AS DOUBLE) AS nothing FROM customer")
def _(t, spark):
    x, k = F.col("c_acctbal"), F.col("c_nationkey")
    rows = t("customer").select(
        "c_custkey", maths.sqrt(F.abs(x)).alias("s0"), F.abs(x).alias("a"), maths.sign(x).alias("g"), maths.ceil(x).alias("up"), maths.floor(x).alias("down"), maths.trunc(x).alias("cut"), maths.one_argument("degrees", k).alias("d0"), maths.power(k, F.lit(1.5)).alias("p0"),
        (maths.one_argument("sin", k) * 100).alias("n0"), (F.atan2(k.cast("double"), F.lit(3.0)) * 100).alias("t0"), maths.one_argument("acos", k + 2).alias("nothing"),
    )
    return rows.selectExpr("c_custkey", "a", "g", "up", "down", "cut", "nothing", f"{r2('s0')} AS s", f"{r2('d0')} AS d", f"{r2('p0')} AS p", f"{r2('n0')} AS sine", f"{r2('t0')} AS at2")


@frame("fn_round", "SELECT o_orderkey, sign(o_totalprice) * floor(abs(o_totalprice) * 10 + 0.5) / 10 AS one, sign(-2.5::DOUBLE) * floor(abs(-2.5::DOUBLE) + 0.5) AS half FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", maths.round_away(F.col("o_totalprice"), 1).alias("one"), maths.round_away(F.lit(-2.5)).alias("half"))


@frame("fn_log", f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {r2('ln(c_acctbal)')} END AS l, CASE WHEN c_acctbal > 0 THEN {r2('ln(c_acctbal) / ln(2::DOUBLE)')} END AS b FROM customer")
def _(t, spark):
    x = F.col("c_acctbal")
    rows = t("customer").select("c_custkey", maths.ln(x).alias("l0"), maths.log_base(F.lit(2.0), x).alias("b0"))
    return rows.selectExpr("c_custkey", f"{r2('l0')} AS l", f"{r2('b0')} AS b")


@frame("fn_int_division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_orderkey // (l_linenumber - 3) END AS q, CASE WHEN l_linenumber <> 3 THEN l_orderkey % (l_linenumber - 3) END AS r FROM lineitem")
def _(t, spark):
    a, b = F.col("l_orderkey"), (F.col("l_linenumber") - 3).cast("bigint")
    return t("lineitem").select("l_orderkey", "l_linenumber", maths.divide(a, b, True).alias("q"), maths.remainder(a, b).alias("r"))


# --- dates ---

_MONTHS = "CAST(CAST(date_trunc('month', ts) AS DATE) + INTERVAL 1 MONTH AS DATE) + CAST(day(ts) - 1 AS INTEGER)"


@frame("fn_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events")
def _(t, spark):
    x = F.col("ts")
    return t("events").select("event_id", dates.date_text(x).alias("d"), dates.time_text(x).alias("t"), dates.datetime_text(x).alias("dt"), dates.unixepoch(x).alias("u"))


@frame("fn_strftime", "SELECT event_id, strftime(ts, '%Y/%m/%d %H.%M.%S day %j week %U %W weekday %w %u %I %p') AS s FROM events")
def _(t, spark):
    return t("events").select("event_id", dates.strftime("%Y/%m/%d %H.%M.%S day %j week %U %W weekday %w %u %I %p", F.col("ts")).alias("s"))


@frame("fn_date_modifiers", f"SELECT event_id, strftime({_MONTHS}, '%Y-%m-%d') AS month_on, strftime(date_trunc('month', ts) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS a, strftime(CAST(ts AS DATE) + CAST((7 + 1 - dayofweek(ts)) % 7 AS INTEGER), '%Y-%m-%d') AS monday FROM events")
def _(t, spark):
    x = F.col("ts")
    return t("events").select("event_id", dates.date_text(dates.modify(x, "+1 month")).alias("month_on"), dates.datetime_text(dates.modify(x, "start of month", "+1 day", "+12 hours")).alias("a"), dates.date_text(dates.modify(x, "weekday 1")).alias("monday"))


@frame("fn_date_trunc", "SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS dec, CAST(make_date(((year(o_orderdate) - 1) // 100) * 100 + 1, 1, 1) AS TIMESTAMP) AS cen FROM orders")
def _(t, spark):
    x = F.col("o_orderdate")
    return t("orders").select("o_orderkey", dates.date_trunc("quarter", x).alias("q"), dates.date_trunc("decade", x).alias("dec"), dates.date_trunc("century", x).alias("cen"))


@frame("fn_julianday", f"SELECT event_id, {r2('epoch(ts) / 86400.0 + 2440587.5')} AS j FROM events")
def _(t, spark):
    return t("events").select("event_id", dates.julianday(F.col("ts")).alias("x")).selectExpr("event_id", f"{r2('x')} AS j")


@frame("fn_timediff", "SELECT o_orderkey, printf('%s0000-00-%02d 00:00:00.000', CASE WHEN date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) < 0 THEN '-' ELSE '+' END, abs(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)))) AS d FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", dates.timediff(F.col("o_orderdate"), F.expr("timestamp_ntz '1998-01-01 00:00:00'")).alias("d"))


@frame("fn_parse_time", "SELECT event_id, ts FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def _(t, spark):
    return t("events").select("event_id", dates.parse(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).alias("ts"))


# --- JSON, arrays, vectors ---


@frame("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS nothing, 'integer' AS kind FROM events")
def _(t, spark):
    x = F.col("props")
    return t("events").select("event_id", json_text.extract(x, "$.k").cast("bigint").alias("k"), json_text.extract(x, "$.none").alias("nothing"), json_text.kind(x, "$.k").alias("kind"))


@frame("json_array_object", "SELECT p_partkey, '[' || p_size || ',\"' || p_brand || '\",null]' AS a, '{\"size\":' || p_size || ',\"brand\":\"' || p_brand || '\"}' AS o FROM part")
def _(t, spark):
    return t("part").select("p_partkey", json_text.array(F.col("p_size"), F.col("p_brand"), F.lit(None).cast("string")).alias("a"), json_text.object_(size=F.col("p_size"), brand=F.col("p_brand")).alias("o"))


@frame("json_each", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def _(t, spark):
    return json_text.each(t("events").select("event_id", "props"), "props").select("event_id", "key", "value")


@frame("json_array_elements", "SELECT n_nationkey, unnest(['1', n_name, '3']) AS value FROM nation")
def _(t, spark):
    rows = t("nation").select("n_nationkey", json_text.array(F.lit(1), F.col("n_name"), F.lit(3)).alias("doc"))
    return json_text.array_elements(rows, "doc").select("n_nationkey", "value")


@frame("json_tree", "SELECT event_id, '$' AS fullkey, 'object' AS type, NULL AS atom FROM events UNION ALL SELECT event_id, '$.k', 'integer', json_extract_string(props, '$.k') FROM events")
def _(t, spark):
    return json_text.tree(t("events"), "props", "event_id").select("event_id", "fullkey", "type", "atom")


@frame("json_set", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"seen\":true}' AS s, '{\"k\":0}' AS r, '{}' AS gone, '{\"k\":1,\"z\":2}' AS merged FROM events")
def _(t, spark):
    x = F.col("props")
    return t("events").select("event_id", json_text.set_(x, "$.seen", F.lit("true")).alias("s"), json_text.replace(x, "$.k", F.lit("0")).alias("r"), json_text.remove(x, "$.k").alias("gone"), json_text.patch(x, F.lit('{"k":1,"z":2}')).alias("merged"))


@frame("json_containment", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) = 7 AS has, true AS key, false AS other FROM events")
def _(t, spark):
    x = F.col("props")
    return t("events").select("event_id", json_text.contains(x, F.lit('{"k":7}')).alias("has"), json_text.has_key(x, "k").alias("key"), json_text.has_any(x, "q", "z").alias("other"))


@frame("json_valid_minify", "SELECT event_id, true AS ok, false AS bad, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS m FROM events")
def _(t, spark):
    x = F.col("props")
    return t("events").select("event_id", json_text.valid(x).alias("ok"), json_text.valid(F.concat(x, F.lit("}"))).alias("bad"), json_text.minify(x).alias("m"))


@frame("array_contains_overlap", "SELECT o_orderkey, list_contains([o_custkey % 5, 2], 2) AS c, list_has_any([o_custkey % 5, o_custkey % 7], [1, 2]) AS o, CAST(len([1, 2, 3]) AS BIGINT) AS n, [o_orderkey, o_custkey][2] AS second FROM orders")
def _(t, spark):
    return t("orders").selectExpr("o_orderkey", "array_contains(array(o_custkey % 5, 2L), 2L) AS c", "arrays_overlap(array(o_custkey % 5, o_custkey % 7), array(1L, 2L)) AS o", "CAST(size(array(1, 2, 3)) AS BIGINT) AS n", "try_element_at(array(o_orderkey, o_custkey), 2) AS second")




def _asked(rows):
    return rows.where(F.col("vec_id") % 50 == 0)


def _all_distances(name: str, metric, oracle: str):
    @frame(name, f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {oracle}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 20")
    def _(t, spark):
        rows = t("embeddings")
        return vectors.nearest_all(rows, _asked(rows), 20, metric).select("query_id", "vec_id", "rank")


_all_distances("vec_l2_topk_all", vectors.l2, "list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")
_all_distances("vec_cosine_topk_all", vectors.cosine, "list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")
_all_distances("vec_ip_topk_all", vectors.inner_product_distance, "-list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")


for _metric in ("l2", "cosine", "ip"):  # two names of one search
    QUERIES[f"vec_{_metric}_topk"], ORACLES[f"vec_{_metric}_topk"] = QUERIES[f"vec_{_metric}_topk_all"], ORACLES[f"vec_{_metric}_topk_all"]


@frame("vec_dims_from_text", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def _(t, spark):
    text = F.to_json(F.col("embedding"))
    return t("embeddings").select("vec_id", vectors.dims(vectors.from_text(text)).cast("bigint").alias("n"))


@frame("vec_lsh", None)
def _(t, spark):
    rows = t("embeddings")
    return vectors.nearest_all_by_hash(rows, _asked(rows), 10).select("query_id", "vec_id", "distance")
