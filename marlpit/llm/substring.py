"""Removal of repeated word passages: a compressed FM-index per shard gives matching statistics of streamed text.

A window is `window` consecutive words of one document. A word is removed when it is covered by a window whose word
sequence also starts in a document with a smaller id; windows are judged on the input.

1. Every window picks an anchor, the smallest hash of its runs of `ANCHOR` words, so equal windows pick equal anchors.
   Anchors found in documents of different ids are counted; only text around those can repeat.
2. A stretch of neighbouring windows with one shared anchor is a segment. Equal segments become one, with the smallest
   id, before they are shuffled. A shard holds the segments of some anchors, about SHARD_WORDS words. Anchors with
   more than HOT documents would make large shards: their windows become segments of their own, dealt by content.
3. Each shard builds FM-indexes (wavelet matrix over the Burrows-Wheeler transform) of segments of smaller ids, and
   streams the segments of larger ids, which are not in them, through backward search: where matching statistics
   reach the window's length, the suffix interval leads to the smallest id that has the window.
4. Windows found in a smaller id go back to their documents as spans; covered words are left out.

Null and empty texts have no words; texts shorter than the window keep all. Documents with equal ids don't count as
smaller than each other; a null id is never smaller or larger than another, so such a document is kept whole and removes nothing.
Ids must be whole numbers: other types raise TypeError. An empty table gives an empty result; other columns are not read,
but for names that begin with __mp_, which are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from marlpit.llm.fm import FMIndex
from marlpit.llm.text import encode_words, give_back, hot_join, in_turn, materialize, mix, ranges, slices, split_words, word_hashes

WINDOW, ANCHOR, PIECE = 50, 16, 64
#: Words of a shard; documents with an anchor beyond which its stretches alone would fill a shard (about 75 words each),
#: and its windows are dealt one by one.
SHARD_WORDS, HOT = 400_000, 5000
NONE = np.iinfo(np.int64).max


def anchors(h: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window's place, windows, anchor) of each stretch of windows that pick one anchor, at most PIECE windows."""
    none = np.zeros(0, np.int64)
    k = min(ANCHOR, window)
    if len(h) < window:
        return none, none, none, np.zeros(0, np.uint64)
    g, step = h, 1
    while step < k:  # hashes of runs of 2, 4, ... words
        more = min(step, k - step)
        g = mix(g[: len(g) - more] * np.uint64(0x9E3779B97F4A7C15) + g[more:])
        step += more
    m, span, wide = g, 1, window - k + 1
    while span < wide:  # smallest of 2, 4, ... neighbours
        more = min(span, wide - span)
        m = np.minimum(m[: len(m) - more], m[more:])
        span += more
    count = np.maximum(np.diff(off) - window + 1, 0)
    at = ranges(off[:-1], count)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    row, own = np.repeat(np.arange(len(count)), count), m[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    cuts = -(-size // PIECE)
    first = np.repeat(first, cuts) + ranges(np.zeros(len(cuts), np.int64), cuts) * PIECE
    size = np.minimum(np.repeat(size, cuts) - ranges(np.zeros(len(cuts), np.int64), cuts) * PIECE, PIECE)
    return row[first], at[first], size, own[first]


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            for at, part in slices(b.column(1)):
                flat, off = split_words(part)
                row, _, _, anchor = anchors(word_hashes(flat), off, window)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.record_batch({"id": b.column(0).take(pa.array(row[new] + at)), "anchor": pa.array(anchor[new].view(np.int64))})

    return run


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            ids, texts, cold, hot = b.columns
            for at, part in slices(texts):
                n = len(part)
                flat, off = split_words(part)
                row, place, size, anchor = anchors(word_hashes(flat), off, window)
                sets = [np.unique(np.asarray(c.slice(at, n).flatten())).astype(np.int64).view(np.uint64) for c in (cold, hot)]
                whole, single = np.isin(anchor, sets[0]), np.isin(anchor, sets[1])
                # a hot anchor's windows one by one, dealt by their own content
                r1, p1, s1, a1 = row[whole], place[whole], size[whole], anchor[whole]
                cut = size[single]
                r2, p2 = np.repeat(row[single], cut), ranges(place[single], cut)
                r, p, s = np.concatenate([r1, r2]), np.concatenate([p1, p2]), np.concatenate([s1, np.ones(len(r2), np.int64)])
                if not len(r):
                    continue
                words = s + window - 1
                for step in range(0, len(r), 20_000):
                    few = slice(step, step + 20_000)
                    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(words[few])])), flat.take(pa.array(ranges(p[few], words[few]))))
                    text = pc.binary_join(lists, pa.scalar(" ", flat.type))
                    digest = [xxhash.xxh3_128_digest(x) for x in text.cast(pa.large_binary()).to_pylist()]
                    own = np.frombuffer(b"".join(digest), ">u8").astype(np.uint64).reshape(-1, 2)
                    key = np.where(np.arange(step, step + len(own)) < len(r1), np.append(a1, np.zeros(len(r2), np.uint64))[few], own[:, 0])
                    yield pa.record_batch(
                        {
                            "id": ids.take(pa.array(r[few] + at)),
                            "at": pa.array(p[few] - off[r[few]]),
                            "seg": pa.array(digest, pa.binary()),
                            "key": pa.array(key.view(np.int64)),
                            "words": pa.array(words[few]),
                            "single": pa.array(np.arange(step, step + len(own)) >= len(r1)),
                            "text": text.cast(pa.string()),
                        }
                    )

    return run


def smallest_ids(symbols: np.ndarray, off: np.ndarray, key: np.ndarray, low: np.ndarray, copied: np.ndarray, window: int) -> np.ndarray:
    """For each window of a shard's stretches (of small whole numbers), the smallest id of another document found to have it (or NONE), flat.

    The stretches of each anchor are put in the order of their smallest ids and halved again and again: at each level
    an index of the first halves is searched with the second halves. Stretches that several documents have are
    indexed once more, for the first of these, and searched for the others.
    """
    size, top = np.diff(off), int(symbols.max(initial=0)) + 1
    windows = size - window + 1
    first = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), NONE)
    order = np.lexsort((low, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(new)
    group = np.diff(np.append(heads, len(key)))
    place, members = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    place[order], members[order] = np.arange(len(key)) - np.repeat(heads, group), np.repeat(group, group)
    for level in range(max(1, int(group.max(initial=1) - 1).bit_length())):
        block = place >> level
        asked = (block & 1 == 1) | (copied if level == 0 else False)
        indexed = ((block & 1 == 0) & ((block + 1) << level < members)) | (copied if level == 0 else False)
        a, q = np.flatnonzero(indexed), np.flatnonzero(asked)
        if not len(a) or not len(q):
            continue
        own = symbols[ranges(off[a], size[a])]
        there = np.zeros(top, bool)
        there[own] = True
        code = np.where(there, np.cumsum(there), -1)  # the index's symbols count from 1
        index = FMIndex(code[own], np.concatenate([[0], np.cumsum(size[a])]), window, low[a])
        length, begin = index.matching_statistics(code[symbols[ranges(off[q], size[q])]], np.concatenate([[0], np.cumsum(size[q])]))
        spot = ranges(np.cumsum(size[q]) - size[q], windows[q])
        hit = length[spot] >= window  # intervals of suffixes above the threshold
        to = ranges(first[q], windows[q])[hit]
        out[to] = np.minimum(out[to], index.smallest(begin[spot[hit]]))
    return out


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        column = lambda name: np.asarray(table.column(name).combine_chunks())
        flat, off = split_words(table.column("text").combine_chunks().cast(pa.large_string()))
        codes, _ = encode_words(flat)
        found = smallest_ids(codes, off, column("key"), column("low"), column("low") < column("high"), window)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(off) - window + 1)]), pa.int32()), pa.array(found))
        give_back()
        return pa.table({"seg": table.column("seg"), "n": table.column("n"), "lows": lists})

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts array<long>): places of the windows that also start in a smaller id; ids without any are left out."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found = materialize(rows.mapInArrow(_anchor_rows(window), "id long, anchor long"), "anchors")
    shared = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", (F.col("n") > HOT).alias("hot"))
    hits = found.join(shared, "anchor").groupBy("id").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    kind = "id long, at long, seg binary, key long, words long, single boolean, text string"
    segments = materialize(rows.join(hits, "id").select("id", "text", "cold", "hot").mapInArrow(_segments(window), kind), "segments")
    words, total = segments.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    distinct = segments.groupBy("seg", "key", "text", "single").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    # a hot anchor's window that one id has alone is not repeated
    dealt = distinct.where("not single or low < high").select("seg", "text", "key", "low", "high", "n", F.pmod(F.xxhash64("key"), F.lit(1 + words // SHARD_WORDS)).alias("shard"))
    lows = dealt.groupBy("shard").applyInArrow(_search(window), "seg binary, n long, lows array<long>")
    lows = materialize(lows.where(F.array_min("lows") < int(NONE)), "lows")
    places = hot_join(segments.select("id", "at", "seg"), lows, "seg", total)
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size("lows") - 1), lambda i: F.get("lows", i) < F.col("id")), lambda i: F.col("at") + i)
    places = places.select("id", starts.alias("starts")).where(F.size("starts") > 0)
    return places.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts")).select(F.col("id").alias(id_col), "starts")


def _cut(window: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            starts = b.column(b.schema.get_field_index("__mp_starts"))
            texts = b.column(b.schema.get_field_index("__mp_text"))
            for at, part in slices(texts):
                n = len(part)
                flat, off = split_words(part)
                own = starts.slice(at, n)
                size = np.asarray(pc.fill_null(pc.list_value_length(own), 0)).astype(np.int64)
                place = np.asarray(own.flatten()).astype(np.int64) + np.repeat(off[:-1], size)
                edge = np.zeros(len(flat) + 1, np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, np.minimum(place + window, len(flat)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                before = np.concatenate([[0], np.cumsum(~gone)])
                kept = flat.filter(pa.array(~gone)) if gone.any() else flat
                ends = before[off]
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), kept), pa.scalar(" ", kept.type)).cast(pa.string())
                words, left = np.diff(off), np.diff(ends)
                out = b.slice(at, n)
                if whole:  # texts that lose nothing stay as they are
                    text = pc.if_else(pa.array(words == left), texts.slice(at, n), text)
                    rest = {name: out.column(i) for i, name in enumerate(out.schema.names) if not name.startswith("__mp_")}
                    if "n_chars" in rest:
                        rest["n_chars"] = pc.if_else(pa.array(words == left), rest["n_chars"], pc.utf8_length(text).cast(rest["n_chars"].type))
                    yield pa.record_batch({name: text if name == "text" else c for name, c in rest.items()})
                else:
                    yield pa.record_batch({"id": out.column(0), "n_words": pa.array(words), "n_removed": pa.array(words - left), "kept": text})

    return run


def _with_starts(docs: DataFrame, window: int) -> tuple[DataFrame, Column]:
    starts = repeated_windows(docs, window).select(F.col("doc_id").alias("__mp_id"), F.col("starts").alias("__mp_starts"))
    return docs.join(starts, F.col("doc_id").cast("long") == F.col("__mp_id"), "left").drop("__mp_id")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text's words without the repeated ones, joined by one space."""
    rows = _with_starts(docs.select("doc_id", "text"), window).select(F.col("doc_id").alias("id"), F.col("text").alias("__mp_text"), "__mp_starts")
    out = rows.mapInArrow(_cut(window, False), f"id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", "doc_id")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words cut from text, and n_chars following it; other texts are unchanged. Columns as in docs."""
    rows = _with_starts(docs, window).withColumn("__mp_text", F.col("text"))
    return rows.mapInArrow(_cut(window, True), docs.schema)
