"""The nearest rows of many query vectors, a block of rows a task: matrix products leave out, plain sums decide.

A task holds one block of rows and lets the queries pass. Products of doubles bound each pair's distance; only pairs that
may be among a query's k nearest so far are measured, by sums in the order of the elements, so that distances are those
of vectors.l2, cosine and inner_product_distance to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and rows of a product, and pairs measured at once.
QUERIES, ROWS, PAIRS = 512, 4096, 1 << 16
EPS = 2.0**-52


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products, summed in the order of the elements."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        out += a[..., j] * b[..., j]
    return out


class L2:
    def measure(self, r, q):
        return np.sqrt(dots(d := r - q, d))

    def row_side(self, r):
        return np.column_stack([r, (r * r).sum(1)])

    def query_side(self, q):
        return np.column_stack([-2 * q, np.ones(len(q))])

    def limit(self, kth, q, longest):
        size = np.sqrt((q * q).sum(1))
        return kth * kth - size * size + 8 * (q.shape[1] + 8) * EPS * (size + longest) ** 2


class InnerProduct:
    def measure(self, r, q):
        return -dots(r, q)

    def row_side(self, r):
        return r

    def query_side(self, q):
        return -q

    def limit(self, kth, q, longest):
        return kth + 8 * (q.shape[1] + 8) * EPS * np.sqrt((q * q).sum(1)) * longest


class Cosine:
    def measure(self, r, q):
        size = np.sqrt(dots(r, r) * dots(q, q))
        return np.where(size == 0, -np.inf, 1 - dots(r, q) / size)  # -inf: null

    def row_side(self, r):
        size = np.sqrt((r * r).sum(1))[:, None]
        return np.divide(r, size, out=np.zeros_like(r), where=size != 0)

    def query_side(self, q):
        return -self.row_side(q)

    def limit(self, kth, q, longest):
        return kth - 1 + 8 * (q.shape[1] + 8) * EPS


def _vectors(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of each dimension in a batch; null vectors and those with null elements are at no distance."""
    size = pc.list_value_length(lists)
    whole = pc.is_valid(lists)
    flat = lists.flatten()
    if flat.null_count:
        bad = pc.list_parent_indices(lists).filter(pc.is_null(flat))
        keep = np.asarray(whole).copy()
        keep[np.asarray(bad)] = False
        whole = pa.array(keep)
    ids, lists, size = ids.filter(whole), lists.filter(whole), size.filter(whole)
    for n in size.unique().to_pylist():
        own = pc.equal(size, n)
        part = lists.filter(own)
        yield ids.filter(own), np.asarray(part.flatten()).reshape(len(part), n)


def _ordered(ids: pa.Array) -> np.ndarray:
    """Places of the ids in their order, nulls first: what ties are broken by."""
    order = np.asarray(pc.array_sort_indices(ids, null_placement="at_start"))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


class Block:
    """Rows of one dimension, those of equal vectors with the k smallest ids only."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, metric, planes: np.ndarray | None, bucket: float):
        place = _ordered(ids)
        if vectors.shape[1]:
            same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        else:
            same = np.zeros(len(vectors), np.int64)
        order = np.lexsort((place, same))
        groups = same[order]
        kept = np.sort(order[np.arange(len(order)) - np.searchsorted(groups, groups) < k])
        self.ids, self.vectors, self.place = ids.take(pa.array(kept)), vectors[kept], place[kept]
        self.k, self.metric, self.planes, self.bucket = k, metric, planes, bucket

    def ready(self) -> Block:
        """The block with its side of the products."""
        r = self.vectors.astype(np.float64)
        sizes = np.sqrt((r * r).sum(1))
        self.longest = float(np.max(sizes, where=np.isfinite(sizes), initial=0.0))
        with np.errstate(all="ignore"):
            self.side = self.metric.row_side(r)
        self.hashes = self.buckets(r)
        return self

    def buckets(self, v: np.ndarray) -> np.ndarray | None:
        """Of each random projection, the bucket a vector falls in."""
        if self.planes is None or self.planes.shape[1] != v.shape[1]:
            return None
        return np.column_stack([np.floor(dots(v, p[None]) / self.bucket) for p in self.planes])

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance): the k nearest rows to each query, those that share no bucket left out."""
        q = q.astype(np.float64)
        side, hashes = self.metric.query_side(q), self.buckets(q)
        limit = np.full(len(q), np.inf)
        if isinstance(self.metric, Cosine):
            limit[~q.any(1)] = -np.inf  # no length, no distance
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 64
        while at < len(self.vectors):
            # limits come from few rows at first, so that few pairs are measured
            bounds = side @ self.side[at : at + step].T
            a, b = np.nonzero(~(bounds > limit[:, None]))  # bounds that are no numbers tell nothing
            if len(a):
                found = self._best(found, a, b + at, q, hashes)
                n = np.bincount(found[0], minlength=len(q))
                full = n >= self.k
                kth = found[2][(np.cumsum(n) - 1)[full]]
                limit[full] = self.metric.limit(kth, q[full], self.longest)
            at, step = at + step, min(2 * step, ROWS)
        return found

    def _best(self, found, a, b, q, hashes):
        parts = [found]
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            if self.planes is not None:
                shared = (hashes[x] == self.hashes[y]).any(1) if hashes is not None and self.hashes is not None else np.zeros(len(x), bool)
                x, y = x[shared], y[shared]
            distance = self.metric.measure(self.vectors[y].astype(np.float64), q[x])
            there = distance != -np.inf if isinstance(self.metric, Cosine) else slice(None)
            parts.append((x[there], y[there], distance[there]))
        x, y, distance = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((self.place[y], distance, x))
        x, y, distance = x[order], y[order], distance[order]
        best = np.arange(len(x)) - np.searchsorted(x, x) < self.k
        return x[best], y[best], distance[best]


def search(k: int, metric, planes: list[list[float]] | None = None, bucket: float = 1.0):
    """For mapInArrow over (block, asked, vec_id, embedding), of each block the rows before the queries:
    (query_id, vec_id, distance) of the k nearest rows of the block to each query."""
    planes = None if planes is None else np.array(planes, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, waiting = None, {}, {}  # by dimension: the rows, and parts not yet put together

        def collect(n: int) -> None:
            parts = [*([(held[n].ids, held[n].vectors)] if n in held else []), *waiting.pop(n)]
            held[n] = Block(pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k, metric, planes, bucket)

        for batch in batches:
            numbers, asked = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asked) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(numbers)]):
                if a == b:
                    continue
                if numbers[a] != block:
                    block, held, waiting = numbers[a], {}, {}
                for ids, v in _vectors(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)):
                    n = v.shape[1]
                    if not asked[a]:
                        waiting.setdefault(n, []).append((ids, v))
                        if sum(len(p[0]) for p in waiting[n]) > max(ROWS, len(held[n].ids) if n in held else 0):
                            collect(n)  # equal rows don't pile up
                        continue
                    if n in waiting:
                        collect(n)
                    if n not in held:
                        continue
                    if not hasattr(held[n], "side"):
                        held[n].ready()
                    for i in range(0, len(v), QUERIES):
                        with np.errstate(all="ignore"):
                            x, y, distance = held[n].nearest(v[i : i + QUERIES])
                        yield pa.record_batch({"query_id": ids.take(pa.array(x + i)), "vec_id": held[n].ids.take(pa.array(y)), "distance": pa.array(distance)})

    return run
