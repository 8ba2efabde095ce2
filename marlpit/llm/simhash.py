"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprint: texts are lower-cased (A-Z), cut into words and word shingles (repeats included, joined by one
space; a text with fewer words is one shingle); a bit is set when it is set in over half of the shingles' XXH64
(seed 42). A text without words, an empty text and a null text have fingerprint zero and are linked like any
other. Documents whose fingerprints differ in at most `radius` bits are linked; a component is everything
reachable. Ties and repeated rows share a fingerprint, so they are in one component; a null doc_id counts only
where a component has no other.

Equal fingerprints meet first, so that copies cost one row. Two different fingerprints within the radius agree
in at least one of radius + 1 bands of bits; the fingerprints that share a band's value are laid out in tiles
in the order of their population counts and compared with exclusive-or and bit counts, tile against tile,
leaving out tile pairs whose population counts differ beyond the radius. Large buckets are cut by population
count and salt into bounded cells first; each cell meets only cells within reach. A batch returns a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.graph import components, local_components
from marlpit.llm.text import hash_strings, hot_join, in_turn, materialize, row_keys, slices, split_words

#: Rows of a tile, and fingerprints of a bucket beyond which it is cut into cells.
TILE, CELL = 64, 4096


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    for at, part in slices(texts):
        flat, off = split_words(pc.ascii_lower(part))
        n = np.diff(off)
        grams = np.where(n >= shingle, n - shingle + 1, 0)
        rows = np.flatnonzero(grams)
        if len(rows):
            pieces = [flat.slice(i, len(flat) - shingle + 1) for i in range(shingle)]
            joined = pc.binary_join_element_wise(*pieces, pa.scalar(" ", flat.type))
            within = np.ones(len(joined), bool)
            ends = off[1:-1]
            for i in range(1, shingle):  # shingles that would run into the next text
                bad = ends - i
                within[bad[(bad >= 0) & (bad < len(within))]] = False
            h = hash_strings(joined.filter(pa.array(within)))
            out[at + rows] = majority(h, grams[rows])
        for r in np.flatnonzero((n > 0) & (n < shingle)):
            words = flat.slice(off[r], n[r]).to_pylist()
            out[at + r] = hash_strings(pa.array([" ".join(words)]))[0]
    return out


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the bits set in over half of them."""
    starts = np.cumsum(counts) - counts
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def links_in_tiles(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of one bucket; rows come in the order of (bucket, population count)."""
    n = len(fp)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = -n % TILE
    pop = np.bitwise_count(fp).astype(np.int64)
    f = np.concatenate([fp, np.zeros(pad, np.uint64)]).reshape(-1, TILE)
    own = np.concatenate([bucket, np.full(pad, -1)]).reshape(-1, TILE)
    first_bucket, first_pop = bucket[::TILE], pop[::TILE]
    last = np.minimum(np.arange(TILE - 1, n + pad, TILE), n - 1)
    last_bucket, last_pop = bucket[last], pop[last]
    tiles, a, b = len(f), np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = np.arange(tiles)
    for d in range(tiles):
        live = live[live + d < tiles]
        if d:
            near = first_bucket[live + d] == last_bucket[live]
            whole = first_pop[live + d] - last_pop[live] > radius  # rows of the shared bucket only: both ends lie in it
            live = live[near & ~whole]
        if not len(live):
            break
        for part in np.array_split(live, max(1, len(live) // 256)):
            x, y = f[part], f[part + d]
            close = np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= radius
            close &= own[part][:, :, None] == own[part + d][:, None, :]
            if not d:
                close &= np.triu(np.ones((TILE, TILE), bool), 1)
            t, i, j = np.nonzero(close)
            i, j = part[t] * TILE + i, (part[t] + d) * TILE + j
            ok = (i < n) & (j < n)
            a, b = np.concatenate([a, i[ok]]), np.concatenate([b, j[ok]])
            if len(a) > 4 * n + 100_000:
                root = local_components(n, a, b)
                a = np.flatnonzero(root != np.arange(n))
                b = root[a]
    root = local_components(n, a, b)
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(k, f):
            f = f.view(np.uint64)
            order = np.lexsort((f, np.bitwise_count(f), k))
            k, f = k[order], f[order]
            bucket = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            a, b = links_in_tiles(bucket, f, radius)
            return pa.record_batch({"u": pa.array(f[a].view(np.int64)), "v": pa.array(f[b].view(np.int64))})

        for batch in in_turn(batches):  # sorted by bucket: the last one may go on
            k = np.concatenate([held_k, np.asarray(batch.column(0))])
            f = np.concatenate([held_f, np.asarray(batch.column(1))])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield links(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        if len(held_k):
            yield links(held_k, held_f)

    return run


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp at distance 1 to radius: a forest that spans every component."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - hi), 64 - hi + lo).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))))
    rows = nodes.select("fp", F.explode(bands).alias("b")).select("fp", "b.band", "b.value")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "value"])
    pop, salts = F.bit_count("fp"), F.ceil(F.col("n") / CELL)
    small = rows.where(F.col("n") <= CELL).select(F.xxhash64("band", "value").alias("k"), "fp")
    large = rows.where(F.col("n") > CELL).select("fp", "band", "value", pop.alias("p"), F.pmod(F.xxhash64("fp"), salts).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("s"))
    large = large.select("fp", "band", "value", "p", "t", "s", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d"))
    here, there = F.struct("p", "t"), F.struct((F.col("p") + F.col("d")).alias("p"), F.col("s").alias("t"))
    large = large.select(F.xxhash64("band", "value", F.least(here, there), F.greatest(here, there)).alias("k"), "fp").distinct()
    cells = small.unionAll(large).repartition("k").sortWithinPartitions("k")
    return cells.mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, row_key, row_check long, root long, component_id): one row per document.

    root names the component by a fingerprint, component_id by its smallest id. row_key and row_check are two hashes
    of the row's id and text, 128 bits that name it. An empty table gives an empty result; other columns of docs are not read.
    """

    def run(batches):
        for x in in_turn(batches):
            fp = fingerprints(x.column(3), shingle).view(np.int64)
            yield pa.record_batch({"id": x.column(0), "row_key": x.column(1), "row_check": x.column(2), "fp": pa.array(fp)})

    kind = docs.schema[id_col].dataType.simpleString()
    key, check = row_keys(id_col, text_col)
    own = docs.select(F.col(id_col).alias("id"), key.alias("row_key"), check.alias("row_check"), F.col(text_col).alias("text"))
    prints = materialize(own.mapInArrow(run, f"id {kind}, row_key long, row_check long, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(near_links(nodes, radius))
    whole = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lowest = whole.where("fp <> root").groupBy("root").agg(F.min("low").alias("other"))
    named = whole.join(lowest, "root", "left").select("fp", "root", F.least("low", "other").alias("own_low"), "other")
    tops = named.where("fp = root").select(F.col("fp").alias("root"), F.col("own_low").alias("component_id"))
    labels = materialize(whole.select("fp", "n", "root").join(tops, "root"), "labels")
    return hot_join(prints, labels, "fp", total).select(F.col("id").alias(id_col), "fp", "row_key", "row_check", "root", "component_id")


def fingerprint_hex(fp) -> F.Column:
    """Sixteen lower-case hexadecimal digits of a fingerprint held as a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each component, that with the smallest doc_id (of equal ids and texts, one row). Columns as in docs."""
    found = near_duplicates(docs, radius, shingle)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "row_key", "row_check")).alias("best"))
    best = best.select(F.col("best.row_key").alias("__mp_key"), F.col("best.row_check").alias("__mp_check"))
    key, check = row_keys("doc_id", "text")
    own = docs.withColumn("__mp_key", key).withColumn("__mp_check", check)
    return own.join(best, ["__mp_key", "__mp_check"], "left_semi").dropDuplicates(["__mp_key", "__mp_check"]).drop("__mp_key", "__mp_check")
