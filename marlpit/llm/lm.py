"""Language-model scoring with a log-frequency Bloom filter.

Training counts words (exactly, in a table) and pairs of neighbouring words. A count is quantised to one of the levels
of `FLOORS` (exact to 8, then four to the octave), and an n-gram of level q is put into a Bloom filter q times, as
(n-gram, 1) ... (n-gram, q): probing until the first miss reads the level back. A wrong hit costs one level at most
with probability 2 ** -PROBES. The filter is built in segments, by the n-gram's hash; its size follows the corpus.

Probability of word w after v: (1 - b) * floor(vw) / ceiling(v) + b * p1(w), where b depends on v's level and is fitted
by leaving one out over the counted pairs, and p1 is absolute discounting over the levels: what is held back goes to
unknown words, as one class. The sum over words is at most one, but for the filter's wrong hits.

While a filter (of words, of pairs) is no larger than `broadcast_bytes` every worker gets it whole. Beyond, documents
are dealt in lots, each lot's distinct n-grams are sent to the segments, and their levels sent back: the same probes
elsewhere. Lots follow the bytes of text, so that a lot's table and answers stay small whatever the corpus.

A null text is an empty one: one token, the end. An empty table gives an empty result; without any training row the
probability of every token is that of one unknown class, 1. Repeated rows are counted as often as they come and get equal scores. A null doc_id trains
like others. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.text import crc_mod, encode_words, give_back, hash_strings, materialize, mix, slices, split_words

END = "\n"  # no word has white space
PROBES, BITS = 6, 8.66
#: The smallest count of each level, from level 1.
FLOORS = np.array([*range(1, 8), *(int(2 ** (3 + i // 4) * (4 + i % 4) // 4) for i in range(200))], np.float64)
#: Heavier words than 1 in HEAVY of all tokens are at most HEAVY: their exact counts fit in a broadcast. LOT_BYTES: text of a lot.
HEAVY, SEGMENT_WORDS, STEP, LOT_BYTES, PROBED = 1 << 20, 2_000_000, 4 << 20, 16 << 20, 1 << 15
BROADCAST_BYTES = 128 << 20


def level_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(FLOORS, count, side="right")


def floor_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, FLOORS[np.maximum(level, 1) - 1], 0)


def ceiling_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, FLOORS[level] - 1, 0)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(1))


@dataclass
class Filter:
    """Bloom filter in segments: bits of all, and the first bit and number of bits of each."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @staticmethod
    def strides(h: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of (n-gram, j) start, and the step from each to the next."""
        x = mix(h + j * np.uint64(0xD1B54A32D192ED03))
        return x, mix(x) | np.uint64(1)

    @staticmethod
    def place(x: np.ndarray, step: np.ndarray, probe: int, size: np.ndarray) -> np.ndarray:
        return (((x + np.uint64(probe) * step) >> np.uint64(32)) * size) >> np.uint64(32)

    @classmethod
    def segment(cls, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Packed bits of a segment that holds each hash `level` times."""
        each = np.repeat(h, level)
        j = np.arange(len(each)) - np.repeat(np.cumsum(level) - level, level) + 1
        size = np.uint64(max(64, int(np.ceil(len(each) * BITS / 8)) * 8))
        bits = np.zeros(int(size), bool)
        x, step = cls.strides(each, j.astype(np.uint64))
        for i in range(PROBES):
            bits[cls.place(x, step, i, size)] = True
        return np.packbits(bits, bitorder="little")

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Filter:
        size = np.array([8 * len(p) for p in parts], np.uint64)
        return cls(np.concatenate(parts), np.cumsum(size) - size, size)

    def levels(self, h: np.ndarray, segment_hash: np.ndarray | None = None) -> np.ndarray:
        """The level of each n-gram: probes (n-gram, 1), (n-gram, 2), ... until one misses; segment_hash chooses the segments."""
        seg = ((h if segment_hash is None else segment_hash) % np.uint64(len(self.size))).astype(np.int64)
        few = range(0, len(h), PROBED)  # so many at a time that they stay in a core's cache
        return np.concatenate([np.zeros(0, np.int64), *(self._levels(h[i : i + PROBED], seg[i : i + PROBED]) for i in few)])

    def _levels(self, h: np.ndarray, seg: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        live, first, size, j = np.arange(len(h)), self.first[seg], self.size[seg], 1
        while len(live):
            x, step = self.strides(h, np.full(1, j, np.uint64))
            hit = np.ones(len(h), bool)
            for i in range(PROBES):
                at = first + self.place(x, step, i, size)
                hit &= ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                if i == PROBES - 1 or np.count_nonzero(hit) < 0.75 * len(hit):
                    live, h, first, size, x, step = (v[hit] for v in (live, h, first, size, x, step))
                    hit = np.ones(len(h), bool)
            out[live] = j
            j += 1
        return out


@dataclass
class Batch:
    """Tokens of some texts: codes of distinct words, the texts' bounds, and word hashes; every text ends in END."""

    words: pa.Array
    hashes: np.ndarray
    codes: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Batch:
        flat, off = split_words(pc.ascii_lower(texts))
        codes, words = encode_words(flat)
        n = len(off) - 1
        words = pa.concat_arrays([words, pa.array([END], words.type)])
        end = len(words) - 1
        out = np.full(len(codes) + n, end, np.int64)
        own = np.ones(len(out), bool)
        off = off + np.arange(n + 1)
        own[off[1:] - 1] = False
        out[own] = codes
        return cls(words, hash_strings(words, 7), out, off)

    def before(self) -> np.ndarray:
        """The code before each token; a text's first comes after END."""
        out = np.empty_like(self.codes)
        out[1:] = self.codes[:-1]
        out[self.off[:-1]] = len(self.words) - 1
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (first code, second code) and how often each comes."""
        key, count = np.unique(self.before() * len(self.words) + self.codes, return_counts=True)
        return key // len(self.words), key % len(self.words), count

    def token_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs, and each token's place among them: frequent pairs take most probes, once."""
        key, own = np.unique(self.before() * len(self.words) + self.codes, return_inverse=True)
        return pair_hash(self.hashes[key // len(self.words)], self.hashes[key % len(self.words)]), own


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, part in slices(b.column(0), 2 * STEP):
            x = Batch.of(part)
            count = np.bincount(x.codes, minlength=len(x.words))
            yield pa.record_batch({"token": x.words.cast(pa.string()), "n": pa.array(count)})
        give_back()


def _count_pairs(texts: Iterator[pa.Array], word_levels: Callable[[np.ndarray], np.ndarray], segments: int) -> Iterator[pa.RecordBatch]:
    # 64 bits a pair: 40 of the hash within its segment, the levels of both words, and a count
    for column in texts:
        for _, part in slices(column, 2 * STEP):
            x = Batch.of(part)
            level = np.minimum(word_levels(x.hashes), 255).astype(np.uint64)
            v, w, count = x.pairs()
            h = pair_hash(x.hashes[v], x.hashes[w])
            seg = (h % np.uint64(segments)).astype(np.uint16 if segments < 1 << 16 else np.int64)
            each, own = with_counts((h >> np.uint64(24) << np.uint64(24)) | level[v] << np.uint64(16) | level[w] << np.uint64(8), count)
            seg = seg[own]
            order = np.argsort(seg, kind="stable")
            each, cuts = each[order], np.searchsorted(seg[order], np.arange(segments + 1))
            have = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch({"seg": pa.array(have), "rows": pa.array([each[cuts[s] : cuts[s + 1]].tobytes() for s in have], pa.binary())})
        give_back()


def with_counts(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with its count in the lowest byte, a row for each digit of it to the base 64 that isn't 0; and the rows' keys.

    A slice of text sends four rows of a pair at most, however often it has it.
    """
    rows, own = [], []
    for place in range(4):  # a slice is too short for counts of 64 ** 4
        digit = (count >> 6 * place) & 63
        some = np.flatnonzero(digit)
        rows.append(key[some] | (digit[some] | place << 6).astype(np.uint64))
        own.append(some)
    return np.concatenate(rows), np.concatenate(own)


#: Cells of the leave-one-out counts: level of the first word, of the second, and the pair's level.
PAIR_LEVELS = 256


def _pair_segment(key, table):
    rows = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("rows")]))
    ngram, count = rows >> np.uint64(8), (rows & np.uint64(63)).astype(np.int64) << ((rows >> np.uint64(6) & np.uint64(3)).astype(np.int64) * 6)
    first = np.flatnonzero(np.concatenate([[True], ngram[1:] != ngram[:-1]]))
    ngram, count = ngram[first], np.add.reduceat(count, first)
    level = level_of(count)
    cell = ((ngram & np.uint64(0xFFFF)).astype(np.int64)) * PAIR_LEVELS + level
    cells, own = np.unique(cell, return_inverse=True)
    return pa.table(
        {
            "seg": pa.array([key[0].as_py()], pa.int64()),
            "bits": pa.array([Filter.segment(stored(ngram >> np.uint64(16)), level).tobytes()], pa.binary()),
            "cells": pa.array([cells], pa.list_(pa.int64())),
            "tokens": pa.array([np.bincount(own, weights=count).astype(np.int64)], pa.list_(pa.int64())),
        }
    )


def stored(top: np.ndarray) -> np.ndarray:
    """The hash a pair is filed under within its segment: of the 40 bits that are kept."""
    return mix(top + np.uint64(0x51ED270B))


def fit_backoff(cells: dict[int, int], p1: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each level of the first word, the weight of p1 that makes the counted pairs likeliest, each left out once."""
    out = np.full(256, 1.0)
    at, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    v, w, pair = at // PAIR_LEVELS >> 8, at // PAIR_LEVELS & 255, at % PAIR_LEVELS
    one = p1(w)
    seen = np.maximum(floor_of(pair) - 1, 0) / np.maximum(ceiling_of(v) - 1, 1)
    for level in np.unique(v):
        own = v == level
        b = 0.5
        for _ in range(60):
            share = b * one[own] / (b * one[own] + (1 - b) * seen[own])
            b = min(max(float((share * n[own]).sum() / n[own].sum()), 0.05), 0.999)
        out[level] = b
    return out


@dataclass
class Model:
    words: Filter
    pairs: Filter | None
    backoff: np.ndarray
    discount: float
    types: int
    mass: float

    def p1(self, level: np.ndarray) -> np.ndarray:
        """Probability of a word of each level; level 0: of the class of unknown words."""
        if not self.mass:
            return np.ones(len(level))
        return np.where(level > 0, floor_of(level) - self.discount, max(self.discount * self.types, 1e-3)) / self.mass

    def token_scores(self, x: Batch, word_level: np.ndarray, pair_level: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        v, w = x.before(), x.codes
        ceiling, b, p1 = np.maximum(ceiling_of(word_level), 1), self.backoff[np.minimum(word_level, 255)], self.p1(word_level)
        known = word_level > 0
        seen = np.where(known[v] & known[w], np.minimum(floor_of(pair_level) / ceiling[v], 1), 0)
        return np.log10((1 - b[v]) * seen + b[v] * p1[w])


def _text_scores(x: Batch, scores: np.ndarray) -> np.ndarray:
    return np.add.reduceat(scores, x.off[:-1]) if len(x.off) > 1 else np.zeros(0)


def score_corpus(docs: DataFrame, held_out_part: int = 2, of: int = 7, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Learns from rows whose crc32(doc_id as text) modulo `of` is not held_out_part. base_score is add-one smoothing of
    the exact counts, with one class of unknown words.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(crc_mod(F.col("doc_id"), of) == held_out_part, F.lit(False))
    train = docs.where(~held).select("text")
    counts = train.mapInArrow(_count_words, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))
    counts = materialize(counts, "word-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    segments = 1 + total // SEGMENT_WORDS

    # words: exact counts to levels; a segment is built from the rows that its hash gives it
    def hashed(batches):
        for b in batches:
            h = hash_strings(b.column(0), 7)
            yield pa.record_batch({"seg": pa.array((h % np.uint64(segments)).astype(np.int64)), "h": pa.array(h.view(np.int64)), "c": b.column(1)})

    def word_segment(key, table):
        level = level_of(np.asarray(table.column("c")))
        levels, n = np.unique(level, return_counts=True)
        bits = Filter.segment(np.asarray(table.column("h")).view(np.uint64), level).tobytes()
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.binary()), "cells": pa.array([levels], pa.list_(pa.int64())), "tokens": pa.array([n], pa.list_(pa.int64()))})

    built = "seg long, bits binary, cells array<long>, tokens array<long>"
    if total:
        word_segments = materialize(counts.mapInArrow(hashed, "seg long, h long, c long").groupBy("seg").applyInArrow(word_segment, built), "word-segments")
        levels = np.zeros(256)
        for r in word_segments.select(F.explode(F.arrays_zip("cells", "tokens")).alias("x")).groupBy("x.cells").agg(F.sum("x.tokens")).collect():  # a row per level
            levels[r[0]] = r[1]
        once, twice = max(levels[1], 1), levels[2]
        floors = floor_of(np.arange(256) % 200)
        model = Model(None, None, None, once / (once + 2 * twice), types, float((levels * floors).sum()))
    else:
        model = Model(None, None, np.ones(256), 0.5, 0, 0.0)

    size = lambda df: df.agg(F.sum(F.octet_length("bits"))).first()[0] if total else 64

    def whole(df) -> Filter:
        """The filter of all segments, of a size that was checked; a partition at a time goes through the driver."""
        sizes = np.full(segments, 8, np.int64)
        for r in df.select("seg", F.octet_length("bits").alias("n")).collect() if total else ():
            sizes[r.seg] = r.n
        first = np.cumsum(sizes) - sizes
        bits = np.zeros(int(sizes.sum()), np.uint8)
        for r in df.select("seg", "bits").toLocalIterator() if total else ():
            bits[first[r.seg] : first[r.seg] + sizes[r.seg]] = np.frombuffer(r.bits, np.uint8)
        return Filter(bits, (8 * first).astype(np.uint64), (8 * sizes).astype(np.uint64))

    word_table = word_segments if total else None
    few_words = not total or size(word_table) <= broadcast_bytes
    sent_words = spark.sparkContext.broadcast(whole(word_table)) if few_words else None
    # row_key names a row from one pass over the input to its sums, within one query
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_key"))

    def in_lots() -> DataFrame:
        """Rows with their lot: as many lots as the table's bytes ask for."""
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return rows.withColumn("lot", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // LOT_BYTES)).cast("int"))

    pair_segments = word_answers = lots = None
    if total:
        schema = "seg long, rows binary"
        if few_words:

            def count_pairs(batches):
                return _count_pairs((b.column(0) for b in batches), sent_words.value.levels, segments)

            counted = train.mapInArrow(count_pairs, schema)
        else:
            lots = in_lots()
            word_answers = materialize(_answers(lots, _word_hashes, word_segments, segments, lambda f, h: f.levels(h)), "word-levels")

            def count_lot(key, table, answers):
                found = list(_count_pairs(iter([table.column("text")]), _lookup(answers), segments))
                return pa.Table.from_batches(found, pa.schema([("seg", pa.int64()), ("rows", pa.binary())]))

            train_lots = lots.where(~held).groupBy("lot").cogroup(word_answers.groupBy("lot"))
            counted = train_lots.applyInArrow(count_lot, schema)
        pair_segments = materialize(counted.groupBy("seg").applyInArrow(_pair_segment, built), "pair-segments")
        cells = {r[0]: r[1] for r in pair_segments.select(F.explode(F.arrays_zip("cells", "tokens")).alias("x")).groupBy("x.cells").agg(F.sum("x.tokens")).collect()}  # bounded: levels
        model.backoff = fit_backoff(cells, model.p1)

    # exact counts of heavy words, at most HEAVY of them, go along; the others' meet by a join
    base = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if total:
        heavy = counts.where(F.col("c") * HEAVY >= total).mapInArrow(hashed, "seg long, h long, c long").select("h", "c").toArrow()
        heavy_hash = np.asarray(heavy.column("h").combine_chunks()).view(np.uint64)
        order = np.argsort(heavy_hash)
        base = (heavy_hash[order], np.asarray(heavy.column("c").combine_chunks())[order])
    context = spark.sparkContext.broadcast((model.backoff, model.discount, model.types, model.mass, base))

    def rows_of(x: Batch, keys: pa.Array, ids: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row with a summary for each text, and rows (token, times) for its words that are not heavy."""
        known_hash, known_count = context.value[4]
        at = np.minimum(np.searchsorted(known_hash, x.hashes), max(len(known_hash) - 1, 0))
        is_heavy = known_hash[at] == x.hashes if len(known_hash) else np.zeros(len(x.hashes), bool)
        c = np.where(is_heavy, known_count[at] if len(known_hash) else 0, 0)
        logs = np.where(is_heavy, np.log10((c + 1) / (total + types + 1)), 0)
        n, n_texts = np.diff(x.off), len(x.off) - 1
        rare = np.flatnonzero(~is_heavy[x.codes])
        key, times = np.unique(np.searchsorted(x.off, rare, side="right") * len(x.words) - len(x.words) + x.codes[rare], return_counts=True)
        own, word = key // len(x.words), key % len(x.words)
        marks = pc.binary_join_element_wise(pa.scalar(END, pa.string()), keys.cast(pa.string()), "")  # no word's text
        sums = pa.StructArray.from_arrays(
            [ids, pa.array(n), pa.array(np.add.reduceat(is_heavy[x.codes].astype(np.int64), x.off[:-1])), pa.array(np.add.reduceat(logs[x.codes], x.off[:-1])), pa.array(scores)],
            names=["doc_id", "n_tokens", "heavy", "base", "score"],
        )
        yield pa.record_batch({"row_key": keys, "token": marks, "times": pa.array(np.zeros(n_texts, np.int64)), "text": sums})
        yield pa.record_batch({"row_key": keys.take(pa.array(own)), "token": x.words.take(pa.array(word)).cast(pa.string()), "times": pa.array(times), "text": pa.nulls(len(own), sums.type)})

    out = f"row_key long, token string, times long, text struct<doc_id: {kind}, n_tokens: bigint, heavy: bigint, base: double, score: double>"
    if few_words and (not total or size(pair_segments) <= broadcast_bytes):
        sent_pairs = spark.sparkContext.broadcast(whole(pair_segments))

        def run(batches):
            own = Model(sent_words.value, sent_pairs.value, *context.value[:4])
            for b in batches:
                for at, part in slices(b.column(1), STEP):
                    x = Batch.of(part)
                    pairs, places = x.token_pairs()
                    found = SegmentedPairs(own.pairs, segments).levels(pairs)
                    scores = own.token_scores(x, own.words.levels(x.hashes), found[places])
                    yield from rows_of(x, b.column(2).slice(at, len(part)), b.column(0).slice(at, len(part)), _text_scores(x, scores))
                give_back()

        scored = rows.select("doc_id", "text", "row_key").mapInArrow(run, out)
    else:
        lots = in_lots() if lots is None else lots
        if word_answers is None:
            word_answers = _answers(lots, _word_hashes, word_segments, segments, lambda f, h: f.levels(h))
        pair_answers = _answers(lots, _pair_hashes, pair_segments, segments, lambda f, h: SegmentedPairs(f, 1).levels(h))
        scored = _scored_by_lots(lots, word_answers.unionAll(pair_answers), context, rows_of, out)
    joined = scored.join(counts, "token", "left")
    add_one = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + types + 1)))
    joined = joined.groupBy("row_key").agg(
        *(F.max(f"text.{c}").alias(c) for c in ("doc_id", "n_tokens", "heavy", "base", "score")),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("times") > 0, F.col("times") * add_one).otherwise(0.0)).alias("rare"),
    )
    joined = joined.select("doc_id", "n_tokens", (F.col("heavy") + F.col("known")).alias("n_known"), (F.col("base") + F.col("rare")).alias("base_score"), "score")
    return joined.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


@dataclass
class SegmentedPairs:
    """Probes a filter whose segments are chosen by the whole hash, and places by its upper 40 bits."""

    pairs: Filter
    segments: int

    def levels(self, h: np.ndarray) -> np.ndarray:
        return self.pairs.levels(stored(h >> np.uint64(24)), h)


def _texts_of(table: pa.Table) -> Iterator[tuple[int, int, Batch]]:
    for at, part in slices(table.column("text"), STEP):
        yield at, len(part), Batch.of(part)


def _word_hashes(x: Batch) -> np.ndarray:
    return x.hashes


def _pair_hashes(x: Batch) -> np.ndarray:
    return x.token_pairs()[0]


def _answers(rows: DataFrame, hashes: Callable[[Batch], np.ndarray], table: DataFrame, segments: int, levels: Callable) -> DataFrame:
    """(lot, h, levels): each lot's distinct n-grams go to their segments and come back with their levels."""

    def ask(key, texts):
        h = np.unique(np.concatenate([np.zeros(0, np.uint64), *(hashes(x) for _, _, x in _texts_of(texts))]))
        seg = (h % np.uint64(segments)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        h, cuts = h[order], np.searchsorted(seg[order], np.arange(segments + 1))
        have = np.flatnonzero(np.diff(cuts))
        return pa.table({"lot": pa.array([key[0].as_py()] * len(have), pa.int32()), "seg": pa.array(have), "h": pa.array([h[cuts[s] : cuts[s + 1]].tobytes() for s in have], pa.binary())})

    def answer(key, asked, segment):
        f = Filter.of([np.frombuffer(segment.column("bits")[0].as_buffer(), np.uint8) if len(segment) else np.zeros(8, np.uint8)])
        found = [levels(f, np.frombuffer(x.as_buffer(), np.uint64)).astype(np.uint8).tobytes() for x in asked.column("h")]
        return pa.table({"lot": asked.column("lot"), "h": asked.column("h"), "levels": pa.array(found, pa.binary())})

    asked = rows.groupBy("lot").applyInArrow(ask, "lot int, seg long, h binary")
    return asked.groupBy("seg").cogroup(table.select("seg", "bits").groupBy("seg")).applyInArrow(answer, "lot int, h binary, levels binary")


def _lookup(answers: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    """Levels by hash, from a lot's answers."""
    h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in answers.column("h"))])
    level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in answers.column("levels"))]).astype(np.int64)
    order = np.argsort(h)
    h, level = h[order], level[order]
    return lambda asked: level[np.searchsorted(h, asked)]


def _scored_by_lots(rows: DataFrame, answers: DataFrame, context, rows_of, out: str) -> DataFrame:
    """Scores of lots of texts beside the levels of all their words and pairs."""

    def finish(key, table, found):
        levels = _lookup(found)
        own = Model(None, None, *context.value[:4])
        keys, ids, done = table.column("row_key").combine_chunks(), table.column("doc_id").combine_chunks(), []
        for at, n, x in _texts_of(table):
            pairs, places = x.token_pairs()
            scores = own.token_scores(x, levels(x.hashes), levels(pairs)[places])
            done += rows_of(x, keys.slice(at, n), ids.slice(at, n), _text_scores(x, scores))
        return pa.Table.from_batches(done)

    return rows.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(finish, out)
