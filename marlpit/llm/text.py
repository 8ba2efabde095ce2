"""Shared text helpers: word splitting on Arrow arrays, hashing, scratch folders."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, so that memory in a task stays bounded.
SLICE_BYTES = 2 << 20
#: A key is hot when more than 1 in so many rows have it.
HOT_SHARE = 1024
#: Java and Python pattern of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir); removed when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder is set only where none is configured and all runs on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = held.get() if held.isDefined() else "/tmp/checkpoints/marlpit"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text: together they tell rows apart at any table's size."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))


def hot_join(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """big joined with small(key, n, ...) on key: small's keys are distinct, and n of the `rows` rows of big have each.

    Keys with more than 1 in HOT_SHARE rows of big, fewer than HOT_SHARE of them, come by a broadcast; the others by a join.
    """
    is_hot = F.col("n") * HOT_SHARE > rows
    hot, cold = small.where(is_hot).drop("n"), small.where(~is_hot).drop("n")
    first = big.join(F.broadcast(hot), key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return first.unionAll(rest.select(first.columns))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a string array, each of about `limit` bytes or one row; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    at, n = 0, len(texts)
    ends = np.cumsum(size)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string array without nulls, flat, and each row's offsets into them."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = np.flatnonzero(np.asarray(pc.equal(pc.binary_length(flat), 0)))
    if len(empty):  # white space at either end of a text leaves an empty piece
        keep = np.ones(len(flat), bool)
        keep[empty] = False
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        flat, offsets = flat.filter(pa.array(keep)), kept_before[offsets]
    return flat, offsets


def encode_words(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words."""
    d = flat.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def hash_strings(values: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each string's UTF-8 bytes."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x, seed) for x in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def word_hashes(flat: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each word; a distinct word is hashed once."""
    codes, words = encode_words(flat)
    return hash_strings(words, seed)[codes] if len(codes) else np.zeros(0, np.uint64)


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; memory freed while one was worked on goes back to the system before the next."""
    for b in batches:
        yield b
        del b
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on, beside others, after its largest slice."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, over the whole array (callers leave out runs across rows)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)
