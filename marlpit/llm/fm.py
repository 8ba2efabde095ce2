"""A compressed FM-index over integer symbols: wavelet matrix of the Burrows-Wheeler transform, matching statistics.

Suffixes are sorted by their first `depth` symbols, which is enough for backward search of patterns of up to `depth`
symbols. Once built, an index holds the wavelet matrix (3/16 byte a symbol for each bit of the alphabet), a byte of
common prefix a symbol, and for each distinct run of `depth` symbols, the smallest id of the texts that have it, found
through a bit a symbol: some 12 bytes a symbol with 100,000 different ones. The suffix array, ranks and texts are
dropped. Queries run in lockstep: one numpy step extends the matches of all of them by a symbol.
"""

from __future__ import annotations

import numpy as np


#: The bits below each place of a word.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit row with rank."""

    def __init__(self, bit: np.ndarray):
        self.packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, np.uint8)]), bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed[:-1]), dtype=np.int64)]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.ones.take(word) + np.bitwise_count(self.packed.take(word) & BELOW.take(at & 63))

    @property
    def nbytes(self) -> int:
        return self.packed.nbytes + self.ones.nbytes


class WaveletMatrix:
    """Rank of any symbol in a sequence, a packed bit row per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.rows = []
        s = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            self.rows.append((level, Bits(bit), len(bit) - int(bit.sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.masks = 1 << np.arange(bits - 1, -1, -1)[:, None]
        self.base = self.walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        bits = (symbol & self.masks) != 0
        for bit, (_, row, zeros) in zip(bits, self.rows):
            one = row.rank(at)
            at = np.where(bit, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.walk(symbol, at) - self.base[symbol]


class FMIndex:
    """Index over texts, each a run of positive symbols with an id; matches never run over a text's end."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, depth: int, ids: np.ndarray | None = None):
        lengths = np.diff(offsets)
        n = self.size = len(symbols) + len(lengths)
        text = np.zeros(n, np.int64)  # 0 ends each text
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)] = symbols
        self.depth = depth
        used = np.bincount(text) > 0
        ranks = {1: (np.cumsum(used) - 1)[text]}
        have = 1
        while have < depth:
            step = min(have, depth - have)
            ranks[have + step] = self._join(ranks[have], step)
            have += step
        sa = np.argsort(ranks[depth], kind="stable")
        self.top = int(text.max()) + 1 if n else 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top))])
        self.bwt = WaveletMatrix(text[sa - 1], max(1, int(self.top - 1).bit_length()))
        self.lcp = self._lcp(sa, ranks)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        whole = np.zeros(n + depth, bool)  # suffixes of depth symbols or more: no end among them
        ends = np.cumsum(lengths + 1) - 1
        whole[np.arange(n)] = (ends[owner] - np.arange(n) >= depth) if n else False
        head = (self.lcp[:-1] < depth) & whole[sa]
        self.marks = Bits(head.astype(np.uint8))
        ids = np.zeros(len(lengths), np.int64) if ids is None else ids
        own = np.where(whole[sa], ids[owner[sa]], np.iinfo(np.int64).max) if n else np.zeros(0, np.int64)
        firsts = np.flatnonzero(self.lcp[:-1] < depth)
        least = np.minimum.reduceat(own, firsts) if n else own
        self.least = least[head[firsts]] if n else least
        self._heads: dict[int, np.ndarray] = {}

    @property
    def nbytes(self) -> int:
        return sum(r.nbytes for _, r, _ in self.bwt.rows) + self.bwt.base.nbytes + self.lcp.nbytes + self.marks.nbytes + self.least.nbytes + self.before.nbytes

    @staticmethod
    def _join(rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks by the symbols of rank and those of rank `step` further on."""
        key = rank * (int(rank.max(initial=0)) + 2)
        key[: len(key) - step] += rank[step:] + 1
        order = np.argsort(key)
        s = key[order]
        out = np.empty_like(rank)
        out[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])[: len(rank)]
        return out

    def _lcp(self, sa: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix in order with the one before it, up to depth; 0 at either end."""
        n = len(sa)
        out = np.zeros(n + 1, np.uint8 if self.depth < 256 else np.int64)
        a, b = sa[:-1].copy(), sa[1:].copy()
        same = np.zeros(len(a), np.int64)
        for h in sorted((h for h in ranks if h & (h - 1) == 0), reverse=True) * 2:
            inside = (a + h <= n) & (b + h <= n) & (same + h <= self.depth)
            r = ranks[h]
            hit = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
            a, b, same = a + h * hit, b + h * hit, same + h * hit
        whole = ranks[self.depth]
        out[1:n] = np.where(whole[sa[:-1]] == whole[sa[1:]], self.depth, same)
        return out

    def heads(self, length: int) -> np.ndarray:
        """Places in suffix order where a new run of `length` symbols begins; kept while the index is searched."""
        if length not in self._heads:
            self._heads[length] = np.append(np.flatnonzero(self.lcp[:-1] < length), self.size).astype(np.int32)
        return self._heads[length]

    def smallest(self, first: np.ndarray) -> np.ndarray:
        """The smallest id of the texts with the run of depth symbols whose suffix interval begins at each place."""
        return self.least[self.marks.rank(first)]

    def matching_statistics(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the queries: the length of the longest match that begins there (at most depth), and the
        first place in suffix order where it is found. Symbols that the index doesn't have are -1."""
        lengths = np.diff(offsets)
        out_len, out_lo = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = offsets[1:][order], lengths[order]
        n = self.size
        lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), n), np.zeros(len(order), np.int64)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            m = int(np.searchsorted(-lengths, -t))  # queries that are longer than t
            at = ends[:m] - 1 - t
            c = symbols[at]
            todo = np.arange(m)
            full = todo[size[:m] == self.depth]
            self._shorten(full, np.full(len(full), self.depth - 1), lo, hi, size)
            known = (c > 0) & (c < self.top)
            lost = todo[~known]
            lo[lost], hi[lost], size[lost] = 0, n, 0
            todo = todo[known]
            while len(todo):
                sym = c[todo]
                both = self.bwt.rank(np.concatenate([sym, sym]), np.concatenate([lo[todo], hi[todo]]))
                start = self.before[sym]
                a, b = start + both[: len(todo)], start + both[len(todo) :]
                ok = a < b
                won = todo[ok]
                lo[won], hi[won] = a[ok], b[ok]
                size[won] += 1
                todo = todo[~ok & (size[todo] > 0)]
                self._shorten(todo, np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]]), lo, hi, size)
            out_len[at], out_lo[at] = size[:m], lo[:m]
        return out_len, out_lo

    def _shorten(self, rows, length, lo, hi, size) -> None:
        """Cut the matches of rows down to a length: wider intervals of suffixes."""
        for k in np.unique(length):
            own = rows[length == k]
            if k:
                heads = self.heads(int(k))
                at = np.searchsorted(heads, lo[own].astype(np.int32), side="right")
                lo[own], hi[own] = heads[at - 1], heads[at]
            else:
                lo[own], hi[own] = 0, self.size
            size[own] = k
