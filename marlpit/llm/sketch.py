"""Bottom-k sketches of documents' word shingles.

A sketch holds the k smallest distinct hashes (63 bits, ascending) of a text's shingles of `SHINGLE` lower-cased
words; a text with fewer words is one shingle, a text without words has an empty sketch. Sketches merge across
parts by keeping the k smallest of all, and estimate resemblance, containment and the number of distinct shingles;
where no hash has been left out, the estimates are exact. Null texts count as empty. Two empty sketches are alike
(1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.text import gram_hashes, slices, split_words, word_hashes

SHINGLE, K = 5, 128
#: Bytes of text in a block of neighbours.
BLOCK_BYTES = 32 << 20


def sketches(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text."""
    out: list[np.ndarray] = []
    for _, part in slices(texts):
        flat, off = split_words(pc.ascii_lower(part))
        h = word_hashes(flat)
        grams = gram_hashes(h, shingle) >> np.uint64(1)
        for a, b in zip(off[:-1], off[1:]):
            n = b - a
            own = grams[a : b - shingle + 1] if n >= shingle else gram_hashes(h[a:b], int(n)) >> np.uint64(1) if n else grams[:0]
            if len(own) > 4 * k:  # only the smallest can count
                cut = np.partition(own, 2 * k)[2 * k]
                few = np.unique(own[own <= cut])
                own = few if len(few) >= k else own
            out.append(np.unique(own)[:k])
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, times = np.unique(np.concatenate([a, b]), return_counts=True)
    n = k if len(a) >= k or len(b) >= k else len(both)
    return float((times[:n] == 2).sum() / len(times[:n]))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << 63) / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b).mean())
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def encoded(sketch: np.ndarray) -> str:
    """A sketch as text: base64 of its big-endian hashes."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketch(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sketch array<long>): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s.view(np.int64) for s in sketches(b.column(1), k, shingle)]
            yield pa.record_batch({id_col: b.column(0), "sketch": pa.array(own, pa.list_(pa.int64()))})

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, sketch array<long>")


def merge(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, sketch) of the union of each key's parts(key, sketch); rows are salted, so a hot key's parts meet in steps."""
    salted = parts.select(key, "sketch", F.spark_partition_id().alias("salt"))

    def union(df: DataFrame, *by: str) -> DataFrame:
        each = df.select(*by, F.explode("sketch").alias("h")).groupBy(*by, "h").agg(F.lit(1)).groupBy(*by)
        return each.agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("sketch"))

    keys = parts.select(key).distinct()
    merged = union(union(salted, key, "salt"), key).withColumnRenamed(key, "__mp_key")
    return keys.join(merged, keys[key].eqNullSafe(merged["__mp_key"]), "left").select(key, F.coalesce("sketch", F.array().cast("array<bigint>")).alias("sketch"))


def with_next(docs: DataFrame, blocks: int | None = None) -> tuple[DataFrame, int]:
    """The number of blocks, after (block, role, key, doc_id, text): documents in blocks of descending doc_id, each block followed by the next one's first row.

    Blocks of some BLOCK_BYTES, and at least as many as there are shuffle partitions, are cut at approximate quantiles
    of doc_id (rows of one id stay in one block) and numbered from 0 in that order; a row of role 1 is a copy of the first document of the
    following block (of the first block, after the last). Null ids come last; equal ids are ordered by text.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    if not blocks:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks))).first()[0] if blocks > 1 else None
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="__mp_at", outputCol="__mp_b").transform(rows.withColumn("__mp_at", F.col("key").cast("double"))).withColumn("block", F.lit(len(splits) - 2) - F.col("__mp_b").cast("int"))
    else:
        rows = rows.withColumn("block", F.lit(0))
    heads = sorted(map(tuple, rows.groupBy("block").agg(F.max("key")).collect()))  # a row per block
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    own = F.struct(F.col("block"), F.lit(0).alias("role"))
    if before:
        ahead = F.broadcast(spark.createDataFrame(before, "__mp_head long, __mp_to int"))  # as many rows as blocks
        rows = rows.join(ahead, F.col("key") == F.col("__mp_head"), "left")
        places = F.when(F.col("__mp_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("__mp_to").alias("block"), F.lit(1).alias("role"))))
    else:
        places = F.array(own)
    return rows.select(F.explode(places).alias("p"), "key", "doc_id", "text").select("p.block", "p.role", "key", "doc_id", "text"), len(splits) - 1


def edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document beside its edited text: the last third of its code points replaced by the next document's first.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); next by descending
    doc_id, around from the last to the first. A single document is its own next.
    """
    ordered, blocks = with_next(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    per = 2 << 20

    def work(ids, texts, following):
        edited, sizes = [], []
        for t, n in zip(texts, following):
            m = len(t) // 3
            sizes.append(len(t))
            edited.append(t[: len(t) - m] + n[:m])
        own = sketches(pa.array([*texts, following[-1]], pa.large_string()), k, shingle)
        new = sketches(pa.array(edited, pa.large_string()), k, shingle)
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, kind_arrow),
                "n_chars": pa.array(sizes, pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                "fingerprint": pa.array(map(encoded, own[:-1])),
                "edited_fingerprint": pa.array(map(encoded, new)),
                "near_edited": pa.array([resemblance(a, b, k) for a, b in zip(own, new)]),
                "near_next": pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])]),
            }
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        # rows of a block in order, then one copy of the next block's first: a row is done when the one after it is known
        ids, texts, following, held, size, closed = [], [], [], None, 0, True
        for b in batches:
            for block, role, i, t in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if role and closed:
                    continue  # further rows that repeat the next block's first
                if held is not None:
                    if following and held[1] is not chain:
                        yield work(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                    ids.append(held[0])
                    texts.append(held[1])
                    following.append(t)
                    chain, size = t, size + len(t)
                    if size > per:
                        yield work(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                closed = bool(role)
                held = None if role else (i, t)
        if ids:
            yield work(ids, texts, following)

    return ordered.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "role", F.desc("key"), "text").mapInArrow(run, out)
