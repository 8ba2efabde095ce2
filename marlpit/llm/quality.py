"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a text alone (never its id, language or source) are standardised and mapped to cosines of random
projections, which approximate a Gaussian kernel. Every partition of the labelled rows adds up its part of the
normal equations, for each of five folds; the sums have a fixed size, and one small system is solved for each
fold left out and one for all. Scores of the rows left out, counted in a fixed number of bins, are made monotone by
pooling adjacent violators; new scores are read off that curve between the pools' centres.

Null and empty texts have all statistics zero and are scored like others. Rows without an id or quality are not
learned from, nor are they held out; a doc_id with several labels counts once for each. Without any labelled row every score is 0.5. Repeated rows get equal scores;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from marlpit.llm.text import crc_mod, encode_words, gram_hashes, in_turn, materialize, slices, split_words, word_hashes

FOLDS, BINS, FAN = 5, 1000, 32
NAMES = ["log_words", "word_length", "symbols", "capitals", "digits", "stops", "marks", "pipes", "non_letters", "distinct", "repeated", "dup_lines", "line_words", "bangs", "odd_ends", "long_words"]
#: Bytes of each kind: 1 symbol, 2 capital, 3 digit, 4 sentence end, 5 other mark, 6 bar, 7 letter, 8 exclamation, 0 white space.
KIND = np.full(256, 7, np.uint8)
KIND[:33] = 0
KIND[[ord(c) for c in "\"'()-/:;[]_`{}~^\\=+@,"]] = 5
KIND[[ord(c) for c in "#*$%&<>"]] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[[ord("."), ord("?")]] = 4
KIND[ord("|")], KIND[ord("!")] = 6, 8


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(np.float64)


def _first_seen(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=rows).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of len(NAMES) numbers for each text."""
    out = [np.zeros((0, len(NAMES)))]
    for _, part in slices(texts):
        n = len(part)
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        byte_off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        kind = KIND[raw[byte_off[0] : byte_off[-1]]]
        byte_off = byte_off - byte_off[0]
        count = [_sums(kind == k, byte_off) for k in range(9)]
        flat, off = split_words(part)
        words = np.diff(off).astype(np.float64)
        row = np.repeat(np.arange(n), np.diff(off))
        length = np.asarray(pc.utf8_length(flat)).astype(np.int64)
        codes, _ = encode_words(flat)
        h = word_hashes(flat)
        grams = gram_hashes(h, 3)
        own = row[2:] == row[: len(row) - 2] if len(row) > 2 else np.zeros(0, bool)
        gram_row = row[: len(grams)][own]
        distinct_grams = _first_seen(gram_row, grams[own], n)
        n_grams = np.bincount(gram_row, minlength=n)
        lines = pc.split_pattern(part, "\n")
        line_flat, line_off = lines.flatten(), np.asarray(lines.offsets).astype(np.int64)
        line_off = line_off - line_off[0]
        line_row = np.repeat(np.arange(n), np.diff(line_off))
        line_codes, _ = encode_words(line_flat)
        n_lines = np.maximum(np.diff(line_off), 1).astype(np.float64)
        dup_lines = n_lines - np.maximum(_first_seen(line_row, line_codes, n), 1)
        chars, some = np.maximum(words, 1), np.maximum(_sums(kind != 0, byte_off), 1)
        last = np.zeros(len(flat), np.uint8)
        if len(flat):
            word_raw, word_off = np.frombuffer(flat.buffers()[2], np.uint8), np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            last = KIND[word_raw[word_off[1:] - 1]]
        odd = np.isin(last, (1, 6, 8))
        out.append(
            np.column_stack(
                [
                    np.log1p(words),
                    _sums(length, off) / chars,
                    count[1] / some,
                    count[2] / some,
                    count[3] / some,
                    count[4] / chars,
                    count[5] / chars,
                    count[6] / chars,
                    1 - (count[7] + count[2]) / some,
                    _first_seen(row, codes, n) / chars,
                    1 - distinct_grams / np.maximum(n_grams, 1),
                    dup_lines / n_lines,
                    np.log1p(words / n_lines),
                    count[8] / chars,
                    _sums(odd, off) / chars,
                    _sums(length > 12, off) / chars,
                ]
            )
            * (words > 0)[:, None]
        )
    return np.concatenate(out)


@dataclass
class Model:
    """What a worker needs to score: fixed sizes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.column_stack([z, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.curve_x):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.curve_x, self.curve_y), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over weighted points in order: each pool's mean x and mean y."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            x = statistics(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch({id_col: b.column(0), "x": lists})

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, len(NAMES))


def fit(found: DataFrame, labels: DataFrame, dimensions: int = 256, ridge: float = 1e-3, seed: int = 7) -> Model:
    """A model from document_statistics() and labels(doc_id, quality); rows whose crc32(doc_id) mod 5 is 0 are held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).where("id is not null and y is not null")
    rows = found.select(F.col("doc_id").alias("id"), "x").join(marked, "id").where(crc_mod(F.col("id"), 5) != 0)
    rows = materialize(rows.select("x", "y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")), "training")
    d = len(NAMES)
    sums = rows.agg(*(F.avg(F.col("x")[i]) for i in range(d)), *(F.stddev_pop(F.col("x")[i]) for i in range(d))).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0, 1 / np.sqrt(d), (d, dimensions)), rng.uniform(0, 2 * np.pi, dimensions)
    none = np.zeros(0)
    if sums[0] is None:
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(dimensions + 1), none, none)
    scale = np.array(sums[d:], float)
    model = Model(np.array(sums[:d], float), np.where(scale > 1e-9, scale, 1), directions, phases, none, none, none)
    size = dimensions + 1

    def equations(batches):
        part = TaskContext.get().partitionId()
        total = np.zeros((FOLDS, size, size + 1))
        for b in in_turn(batches):
            z, y, fold = model.features(_matrix(b.column(0))), np.asarray(b.column(1)), np.asarray(b.column(2))
            for k in range(FOLDS):
                own = z[fold == k]
                total[k] += own.T @ np.column_stack([own, y[fold == k]])
        yield pa.record_batch({"k": pa.array(range(FOLDS), pa.int32()), "part": pa.array([part] * FOLDS, pa.int32()), "m": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(key, parts):
        total = np.zeros(size * (size + 1))
        for m in parts.column("m"):
            total += np.frombuffer(m.as_buffer())
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    # a sum of a fixed size for each partition and fold; FAN of them are added at a time, up a tree
    kind, left = "k int, part int, m binary", rows.rdd.getNumPartitions()
    parts = rows.mapInArrow(equations, kind)
    while left > 1:
        up = parts.select("k", F.floor(F.col("part") / FAN).cast("int").alias("part"), "m")
        parts, left = up.groupBy("k", "part").applyInArrow(add, kind), -(-left // FAN)
    added = {r.k: np.frombuffer(r.m).reshape(size, size + 1) for r in parts.collect()}
    whole = sum(added.values())
    count = max(whole[-1, -2], 1.0)

    def solve(m):
        return np.linalg.solve(m[:, :-1] + ridge * count * np.eye(size) / size, m[:, -1])

    others = np.stack([solve(whole - added[k]) for k in range(FOLDS)])
    model.weights = solve(whole)

    def binned(batches):
        for b in in_turn(batches):
            z, y, fold = model.features(_matrix(b.column(0))), np.asarray(b.column(1)), np.asarray(b.column(2))
            raw = np.einsum("ij,ij->i", z, others[fold])
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.record_batch({"bin": pa.array(at), "raw": pa.array(raw), "y": pa.array(y)})

    counted = rows.mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count("*")).orderBy("bin").collect()
    _, x, y, n = np.array([tuple(r) for r in counted], float).T
    model.curve_x, model.curve_y = isotonic(x, y, n)
    return model


def score(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from document_statistics()."""

    def run(batches):
        for b in in_turn(batches):
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(model.score(_matrix(b.column(1))))})

    return found.select("doc_id", "x").mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from labels that are not held out."""
    found = materialize(document_statistics(docs), "statistics")
    scored = score(found, fit(found, labels))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold. Columns as in docs.

    Statistics are computed once and written beside the rows: the fit reads them without the texts, the filter both.
    """
    at = docs.columns.index("text")

    def measure(batches):
        for b in in_turn(batches):
            x = statistics(b.column(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "__mp_x"])

    both = materialize(docs.mapInArrow(measure, StructType([*docs.schema.fields, StructField("__mp_x", ArrayType(DoubleType()))])), "measured")
    model = fit(both.select("doc_id", F.col("__mp_x").alias("x")), labels)

    def run(batches):
        for b in in_turn(batches):
            yield b.filter(pa.array(model.score(_matrix(b.column(b.num_columns - 1))) >= threshold)).drop_columns(["__mp_x"])

    return both.mapInArrow(run, docs.schema)
