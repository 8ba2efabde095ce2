"""Thin queries over the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import bpe, lm, mixing, quality, rules, sharding, simhash, sketch, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"), held_out_part=2, of=7)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "position")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"), least=100)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edits(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_quality": op4_quality,
    "op5_rules": op5_rules,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_sketch": op9_sketch,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op3_substring": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w),
        h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM s),
        f AS (SELECT g, min(doc_id) AS low FROM h GROUP BY g),
        r AS (SELECT doc_id, list(i) AS starts FROM h JOIN f USING (g) WHERE low < doc_id GROUP BY doc_id),
        u AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w JOIN r USING (doc_id)),
        c AS (SELECT doc_id, list(i) AS cov FROM (SELECT DISTINCT doc_id, s0 + o AS i FROM (SELECT doc_id, unnest(starts) AS s0 FROM r), generate_series(0, 49) AS t(o)) GROUP BY doc_id),
        k AS (SELECT u.doc_id, string_agg(u.ws[u.i], ' ' ORDER BY u.i) AS kept, count(*) AS n_kept
              FROM u LEFT JOIN (SELECT doc_id, unnest(cov) AS i FROM c) x ON u.doc_id = x.doc_id AND u.i = x.i WHERE x.i IS NULL GROUP BY u.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
               CAST(CASE WHEN r.doc_id IS NULL THEN 0 ELSE len(ws) - coalesce(n_kept, 0) END AS BIGINT) AS n_removed,
               sha256(CASE WHEN r.doc_id IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    # CRC-32 byte by byte, from the table of its reflected polynomial
    "op6_sharding": """
        WITH t AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crcs FROM range(256) AS r(i)),
        d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        b AS (SELECT doc_id, md5(body) AS h, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size,
                     list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
        c AS (SELECT doc_id, h, size, xor(coalesce(list_reduce(bytes, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295), 4294967295) AS text_crc32 FROM b, t),
        g AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY h) AS own, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS begins FROM c),
        p AS (SELECT *, CASE WHEN own * 8 * 32 <= total THEN min(begins) OVER (PARTITION BY h) ELSE begins END AS place FROM g),
        s AS (SELECT *, CAST(least(7, place * 8 // total) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM s
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
}
