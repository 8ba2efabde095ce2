"""BPE encoding and decoding of whole texts with a given tokenizer file, by tree concatenation.

A text longer than `leaf` code points is halved until its parts are no longer than that, wherever the cuts fall. The
leaves of all texts of a slice are encoded together, by as many threads as the task has cores. Neighbours are then
joined up the tree, all joins of a level side by side: a window around the join is encoded again, and grows until it
agrees with both sides on whole tokens; what lies between the agreed tokens replaces the two ends. Two tokens that
BPE puts side by side stay so whatever else is around them, so a text made of agreeing pieces is encoded as a whole
one would be. n_joins counts the joins: one less than the leaves.

Within leaves, a file whose white space parts words and is dropped (found by trying) has each distinct word encoded
once, its tokens being kept for the next slices of the worker (when more than KEPT words are held, the half that the
most slices had stays); leaves of other files are encoded as they are. Files whose pieces depend on a text's ends (added
prefix spaces, stripping, dropout, models other than BPE) are refused.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated results; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marlpit.llm.text import encode_words, in_turn, ranges, slices, split_words

#: Most code points of a leaf; bytes of text in a slice; words, and longer texts, handed to the library at once (its
#: results are large); tokens of a window's sides at first; words, and code points in them, whose tokens are kept.
LEAF, STEP_BYTES, WORDS, TEXTS, WINDOW, KEPT, KEPT_POINTS = 2048, 1 << 20, 5000, 250, 8, 300_000, 4_000_000
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

Token = tuple[int, int, int]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, without truncation and padding; one per worker process."""
    context = TaskContext.get()
    cores = context.cpus() if context else 1
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = str(cores > 1).lower(), str(cores)
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        check(json.load(f))
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def check(settings: dict) -> None:
    """Raise for tokenizers whose tokens in the middle of a text depend on where the text begins or ends."""
    model = settings["model"]
    steps = [x for k in ("normalizer", "pre_tokenizer") for x in _steps(settings.get(k))]
    bad = [x["type"] for x in steps if x["type"] in ("Prepend", "Strip", "StripAccents", "Metaspace", "BertNormalizer", "Precompiled") or x.get("add_prefix_space")]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("fuse_unk") or bad:
        raise ValueError(f"parts of a text can't be joined under this tokenizer: {bad or model.get('type')}")


def _steps(x: dict | None) -> list[dict]:
    if not x:
        return []
    inner = x.get("normalizers") or x.get("pretokenizers")
    return [y for z in inner for y in _steps(z)] if inner else [x]


@functools.lru_cache(maxsize=2)
def parted_by_white_space(path: str) -> bool:
    """Whether white space always parts words and leaves no token, tried between all kinds of neighbours."""
    tokenizer = load(path)
    if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    sides = ["a", "Z", "é", "5", "!", "'", "s", "´", "中", "ا", "́", "\x00", " "]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    alone = {s: ids(s) for s in sides}
    gaps = [*" \t\n\x0b\x0c\r", "  ", "\r\n"]
    return all(ids(a + g + b) == alone[a] + alone[b] for a, g, b in itertools.product(sides, gaps, sides))


def cuts(length: int, leaf: int) -> list[int]:
    """Bounds of the leaves of a text: halves of halves, none longer than leaf."""
    n = 1
    while length > n * leaf:
        n *= 2
    return [length * i // n for i in range(n + 1)]


class Tokens:
    """Tokens of a stretch of text: ids, and each one's first code point and end in the text."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray):
        self.ids, self.first, self.end = ids, first, end

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, a: int, b: int) -> Tokens:
        return Tokens(self.ids[a:b], self.first[a:b], self.end[a:b])

    def rows(self, a: int, b: int) -> list[Token]:
        return list(zip(self.ids[a:b].tolist(), self.first[a:b].tolist(), self.end[a:b].tolist()))

    @staticmethod
    def of(rows: list[Token]) -> Tokens:
        return Tokens(*(np.array(c, np.int32) for c in (zip(*rows) if rows else ((), (), ()))))

    @staticmethod
    def concat(parts: list[Tokens]) -> Tokens:
        return Tokens(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "first", "end")))


def seam(left: Tokens, right: Tokens, low: int, cut: int, high: int, reach: int = 0) -> Generator[tuple[int, int], list[Token], Tokens]:
    """Tokens of left + right as if encoded together. Yields (first, end) of text to encode, is sent its tokens.

    low, cut, high: where left begins, both meet, and right ends. Agreement is on two tokens in a row, the first of
    which begins a code point, and counts only beyond `reach` code points from the cut (the longest added token).
    """
    if not len(left) or not len(right):
        return left if len(left) else right
    size = WINDOW
    while True:
        whole_left, whole_right = size >= len(left), size >= len(right)
        start = low if whole_left else int(left.first[len(left) - size])
        end = high if whole_right else int(right.first[size])  # where the next token begins: a composed mark belongs to the one before
        window = yield start, end
        spots = {t: k for k, t in reversed(list(enumerate(window[:-1]))) if not k or t[1] >= window[k - 1][2]}
        keep = (0, 0) if whole_left else None
        if not whole_left:
            from_, own = len(left) - size, left.rows(len(left) - size, len(left))
            for i in range(1, size - 1):
                k = spots.get(own[i])
                if k is not None and own[i][1] >= own[i - 1][2] and own[i + 1][2] <= cut - reach and k + 1 < len(window) - 1 and window[k + 1] == own[i + 1]:
                    keep = from_ + i, k
                    break
        back = None
        if whole_right:
            back = len(right), len(window)
        elif keep:
            # the window's last tokens may be those of a cut word: they don't count
            own = right.rows(0, size)
            for r in range(1, size - 1):
                k = spots.get(own[r])
                if k is not None and own[r][1] >= max(cut + reach, own[r - 1][2]) and k > keep[1] and k + 1 < len(window) - 1 and window[k + 1] == own[r + 1]:
                    back = r, k
                    break
        if keep and back:
            return Tokens.concat([left.part(0, keep[0]), Tokens.of(window[keep[1] : back[1]]), right.part(back[0], len(right))])
        size *= 2


def tree_join(texts: list[str], bounds: list[list[int]], leaves: list[Tokens], encode: Callable[[list[str]], list[list[Token]]], reach: int = 0) -> list[Tokens]:
    """Tokens of each text from those of its leaves (which lie in order, with places in the whole text)."""
    at, parts = 0, []
    for b in bounds:
        parts.append(leaves[at : at + len(b) - 1])
        at += len(b) - 1
    edges = [list(b) for b in bounds]
    while any(len(p) > 1 for p in parts):
        # all joins of a level, of all texts, go on side by side: one call of the library for each round of windows
        running, done = [], {}

        def step(key, text, job, sent):
            try:
                a, b = job.send(sent)
                return key, text, job, a, b
            except StopIteration as e:
                done[key] = e.value

        for n, (p, e) in enumerate(zip(parts, edges)):
            for i in range(0, len(p) - 1, 2):
                running.append(step((n, i), texts[n], seam(p[i], p[i + 1], e[i], e[i + 1], e[i + 2], reach), None))
        running = [x for x in running if x]
        while running:
            found = encode([text[a:b] for _, text, _, a, b in running])
            moved = [step(key, text, job, [(i, x + a, y + a) for i, x, y in own]) for (key, text, job, a, _), own in zip(running, found)]
            running = [x for x in moved if x]
        parts = [[done[n, i] for i in range(0, len(p) - 1, 2)] if len(p) > 1 else p for n, p in enumerate(parts)]
        edges = [e[::2] if len(e) > 2 else e for e in edges]
    return [p[0] for p in parts]


def _spans(tokenizer, texts: list[str]) -> list[list[Token]]:
    out = []
    for at in range(0, len(texts), TEXTS):
        out += [[(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)] for e in tokenizer.encode_batch(texts[at : at + TEXTS], add_special_tokens=False)]
    return out


def _arrays(tokenizer, texts: list[str], few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first code points and ends of all texts' tokens, flat, and how many each text has."""
    ids, spans, size = [], [], []
    for at in range(0, len(texts), few):
        own = tokenizer.encode_batch(texts[at : at + few], add_special_tokens=False)
        lists = [e.ids for e in own]
        size.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        n = int(size[-1].sum())
        ids.append(np.fromiter(itertools.chain.from_iterable(lists), np.int32, n))
        spans.append(np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(e.offsets for e in own)), np.int32, 2 * n).reshape(-1, 2))
    flat = np.concatenate([np.zeros((0, 2), np.int32), *spans])
    return np.concatenate([np.zeros(0, np.int32), *ids]), flat[:, 0], flat[:, 1], np.concatenate([np.zeros(0, np.int64), *size])


def _word_places(texts: pa.Array) -> np.ndarray:
    """The code point at which each word of a string array begins in its text."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    word = ~WHITE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    begins[edges] = word[edges]
    points = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32, out=points[1:])
    at = np.flatnonzero(begins)
    own = np.searchsorted(off, at, side="right") - 1
    return points[at] - points[off[own]]


class KnownWords:
    """Tokens of words: what was encoded for one slice is there for the next."""

    def __init__(self, tokenizer):
        none = np.zeros(0, np.int32)
        self.tokenizer, self.words, self.tokens = tokenizer, {}, (none, none, none)
        self.size, self.points, self.found = (np.zeros(0, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keep half as many words as may be held: those that the most slices had, of equals the newest."""
        order = np.argsort(self.found, kind="stable")[::-1][: KEPT // 2]
        keep = np.sort(order[np.cumsum(self.points[order]) <= KEPT_POINTS // 2])
        take = ranges((np.cumsum(self.size) - self.size)[keep], self.size[keep])
        words = list(self.words)
        self.words = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.tokens = tuple(x[take] for x in self.tokens)
        self.size, self.points, self.found = self.size[keep], self.points[keep], (self.found[keep] + 1) // 2

    def find(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among those known, where new ones are put."""
        if len(self.words) > KEPT or self.points.sum() > KEPT_POINTS:
            self.forget()
        few = words.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.words.get, few, itertools.repeat(-1)), np.int64, len(few))
        new = [few[i] for i in np.flatnonzero(at < 0).tolist()]
        if new:
            at[at < 0] = len(self.words) + np.arange(len(new))
            *tokens, size = _arrays(self.tokenizer, new, WORDS)
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.tokens = tuple(np.concatenate(x) for x in zip(self.tokens, tokens))
            self.size = np.concatenate([self.size, size])
            self.points = np.concatenate([self.points, np.fromiter(map(len, new), np.int64, len(new))])
            self.found = np.concatenate([self.found, np.zeros(len(new), np.int64)])
        self.found[at] += 1
        return at


@functools.lru_cache(maxsize=2)
def known_words(path: str) -> KnownWords:
    return KnownWords(load(path))


def leaf_tokens(leaves: list[str], path: str) -> tuple[Tokens, np.ndarray]:
    """Tokens of all leaves, with places in their own leaf, and the leaves' offsets into them."""
    tokenizer = load(path)
    if not parted_by_white_space(path):
        ids, first, end, size = _arrays(tokenizer, leaves, TEXTS)
        return Tokens(ids, first, end), np.concatenate([[0], np.cumsum(size)])
    array = pa.array(leaves, pa.large_string())
    flat, off = split_words(array)
    codes, words = encode_words(flat)
    known = known_words(path)
    codes = known.find(words)[codes]
    (ids, first, end), size = known.tokens, known.size
    counts = size[codes]
    take = ranges((np.cumsum(size) - size)[codes], counts)
    place = np.repeat(_word_places(array), counts).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return Tokens(ids[take], first[take] + place, end[take] + place), ends[off]


def tree_encode(texts: list[str], path: str, leaf: int = LEAF) -> tuple[list[Tokens], np.ndarray]:
    """Tokens of each text by tree concatenation, and the number of its joins."""
    tokenizer = load(path)
    reach = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    bounds = [cuts(len(t), leaf) for t in texts]
    all_, off = leaf_tokens([t[a:b] for t, e in zip(texts, bounds) for a, b in zip(e, e[1:])], path)
    starts = [a for e in bounds for a in e[:-1]]
    moved = [Tokens(p.ids, p.first + a, p.end + a) if a else p for a, p in zip(starts, (all_.part(x, y) for x, y in zip(off[:-1].tolist(), off[1:].tolist())))]
    found = tree_join(texts, bounds, moved, lambda few: _spans(tokenizer, few), reach)
    return found, np.array([len(e) - 2 for e in bounds], np.int64)


def encode_texts(texts: pa.Array, path: str, leaf: int = LEAF) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets of each row's ids, joins of each row) of slices of a string array."""
    for at, part in slices(texts, STEP_BYTES):
        found, joins = tree_encode(part.to_pylist(), path, leaf)
        off = np.concatenate([[0], np.cumsum([len(t) for t in found])]).astype(np.int64)
        yield at, np.concatenate([np.zeros(0, np.int32), *(t.ids for t in found)]), off, joins


def _encode(path: str, leaf: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in in_turn(batches):
            for at, ids, off, joins in encode_texts(x.column(1), path, leaf):
                raw = ids.astype("<u4")
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])]
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch({id_col: x.column(0).slice(at, len(off) - 1), "n_tokens": pa.array(np.diff(off)), "ids": lists, "ids_sha256": pa.array(sha, pa.string()), "n_joins": pa.array(joins)})

    return run


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids array<int>, ids_sha256 of the ids as little-endian unsigned 32-bit integers, n_joins long)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_encode(path or default_path(), leaf, id_col), f"{id_col} {kind}, n_tokens long, ids array<int>, ids_sha256 string, n_joins long")


def token_strings(path: str) -> pa.Array:
    """The token of each id."""
    found = load(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(found.values()) + 1)
    for token, i in found.items():
        out[i] = token
    return pa.array(out, pa.large_string())


def _decode(path: str):
    with open(path, encoding="utf-8") as f:
        plain = json.load(f).get("decoder") is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_strings(path)
        for x in batches:
            lists = x.column(x.schema.get_field_index("ids"))
            if plain:
                strings = tokens.take(lists.flatten())
                off = np.asarray(lists.offsets).astype(np.int64)
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off - off[0]), strings), pa.scalar(" ", pa.large_string())).cast(pa.string())
            else:
                text = pa.array([load(path).decode(i, skip_special_tokens=False) for i in lists.to_pylist()], pa.string())
            yield pa.record_batch([*x.columns, text], schema=x.schema.append(pa.field("text", pa.string())))

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The table with `text`: the tokens of ids, joined by one space where the tokenizer file names no decoder."""
    return encoded.mapInArrow(_decode(path or default_path()), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, text string")


def round_trip(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins): every text encoded and decoded again, in one pass of a worker."""
    path = path or default_path()
    there, back = _encode(path, leaf, "doc_id"), _decode(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in back(there(batches)):
            sha = [hashlib.sha256(t).hexdigest() for t in x.column(5).cast(pa.binary()).to_pylist()]
            yield pa.record_batch({"doc_id": x.column(0), "n_tokens": x.column(1), "ids_sha256": x.column(3), "decoded_sha256": pa.array(sha, pa.string()), "n_joins": x.column(4)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long")
