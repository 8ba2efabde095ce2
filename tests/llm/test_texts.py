"""Operators on documents against brute force, with the odd rows that the docstrings define."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marlpit.llm import bpe, fm, lm, mixing, quality, queries, rules, sharding, simhash, sketch, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id int, x int"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names the operators use themselves."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [
        (1, "Alpha beta  gamma\ndelta " * 30, "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n ", "en", "b"),
        (5, f"start one {passage} end one", "en", "b"),
        (6, f"start two {passage} end two ### $$$", "de", "b"),
        (7, f"start two {passage} end two ### $$$", "de", "b"),
        (7, f"start two {passage} end two ### $$$", "de", "b"),
        (8, " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000)), "en", "c"),
        (9, "one two", "en", None),
        (10, "two ONE é <|endoftext|> Ünï", "fr", "c"),
        (None, f"{passage} tail", "en", "a"),
        (11, "x" * 9000 + "'s!!" * 800, "en", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "fp", 1, 2) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- SimHash ---


def simhash_by_hand(rows, radius=2):
    prints = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, f"{p:016x}", low[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_simhash(table, request):
    docs = request.getfixturevalue(table)
    found = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex("fp"), "component_id")
    wanted = simhash_by_hand(texts_of(docs))
    assert sorted(map(tuple, found.collect()), key=str) == wanted
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, _, c in wanted} - {None}) + any(c is None for _, _, c in wanted)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_large_buckets(spark, monkeypatch):
    """Buckets cut into cells find the same components."""
    rng = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(0, 20, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "CELL", 16)
    links = [(r.u, r.v) for r in simhash.near_links(nodes).collect()]
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = simhash.local_components(len(fp), np.array([place[u] for u, _ in links]), np.array([place[v] for _, v in links]))
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2, 1))
    assert np.array_equal(got, simhash.local_components(len(fp), a, b))
    # a link leads to the component's first fingerprint, which others may lie between
    assert links and all(u != v and got[place[u]] == got[place[v]] for u, v in links)


# --- substrings ---


def substrings_by_hand(rows, window=50):
    words = [(d, WORD.findall(t)) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table,hot", [("odd", 1000), ("odd", 1), ("real", 1000), ("real", 2)])
def test_substrings(table, hot, request, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    docs = request.getfixturevalue(table)
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == substrings_by_hand(texts_of(docs))


def test_substrings_in_the_pipeline(odd):
    out = substring.without_repeats(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    kept = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert kept[1].text == "Alpha beta  gamma\ndelta " * 30 and kept[2].text is None
    assert kept[6].text == "start two two ### $$$" and kept[6].n_chars == len(kept[6].text) and kept[7].text == ""
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for depth in (2, 5, 50):
        for _ in range(20):
            texts = [rng.integers(1, 4, rng.integers(0, 40)).tolist() for _ in range(5)]
            asked = [rng.integers(1, 6, 30).tolist(), texts[0][3:]]
            flat = lambda s: (np.array(sum(s, []), np.int64), np.cumsum([0, *map(len, s)]).astype(np.int64))
            if not any(texts):
                continue
            index = fm.FMIndex(*flat(texts), depth)
            length, _ = index.matching_statistics(*flat(asked))
            parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, min(len(t), i + depth) + 1)}
            wanted = [max(n for n in range(min(depth, len(q) - i) + 1) if tuple(q[i : i + n]) in parts or n == 0) for q in asked for i in range(len(q))]
            assert length.tolist() == wanted


def test_shard_search_against_brute_force():
    """Many stretches of one anchor: every window finds the smallest other id, through backward search alone."""
    rng = np.random.default_rng(8)
    window = 6
    for _ in range(30):
        n = int(rng.integers(1, 40))
        base = rng.integers(0, 5, 12)
        texts = []
        for _ in range(n):
            t = base.copy()
            t[rng.integers(0, 12, int(rng.integers(0, 3)))] = rng.integers(0, 9)
            texts.append(t[: rng.integers(window, 13)])
        texts = [np.array(t) for t in {tuple(t): 0 for t in texts}]
        n = len(texts)
        key, low, copied = np.zeros(n, np.int64), rng.integers(0, 20, n), rng.random(n) < 0.3
        off = np.cumsum([0, *map(len, texts)])
        got = substring.smallest_ids(np.concatenate(texts), off, key, low, copied, window)
        runs = [[tuple(t[i : i + window]) for i in range(len(t) - window + 1)] for t in texts]
        wanted = []
        for i in range(n):
            for w in runs[i]:
                own = [low[j] for j in range(n) if key[j] == key[i] and w in runs[j] and (j != i or copied[i])]
                wanted.append(min(own, default=substring.NONE))
        # what counts is whether a smaller id is found, and for copies the smallest of all
        for i, (g, w) in enumerate(zip(got, wanted)):
            t = np.searchsorted(np.cumsum([len(r) for r in runs]), i, side="right")
            if w < low[t] or copied[t]:
                assert g == w
            else:
                assert g >= low[t]


def test_removal_needs_the_search(real, monkeypatch):
    monkeypatch.setattr(fm.FMIndex, "matching_statistics", lambda self, symbols, offsets: (np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)))
    flat = np.tile(np.arange(60), 2)
    one = lambda: substring.smallest_ids(flat, np.array([0, 60, 120]), np.zeros(2, np.int64), np.array([1, 2]), np.zeros(2, bool), 50)
    assert (one() == substring.NONE).all()
    monkeypatch.undo()
    assert one().tolist() == [substring.NONE] * 11 + [1] * 11


def test_index_is_compressed():
    rng = np.random.default_rng(9)
    text = rng.integers(1, 30_000, 200_000)
    index = fm.FMIndex(text, np.arange(0, 200_001, 100), 50, np.arange(2000))
    assert index.nbytes < 12 * len(text)
    assert not any(hasattr(index, name) for name in ("sa", "ranks", "owner"))


def test_ids_of_other_kinds(spark):
    with pytest.raises(TypeError):
        substring.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- BPE ---


@pytest.mark.parametrize("table", ["odd", "real"])
def test_bpe(table, request):
    docs = request.getfixturevalue(table)
    tokenizer = bpe.load(bpe.default_path())
    wanted = []
    for d, t in texts_of(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        wanted.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs).drop("n_joins").collect()), key=str) == sorted(wanted, key=str)
    apart = bpe.decode(bpe.encode(docs)).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256))
    assert sorted(map(tuple, apart.collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_concatenation(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    tokenizer = bpe.load(path)
    rng = np.random.default_rng(2)
    kinds = ["abcdefgh", "aA'sret!?", "é̂ñ12", "́e中文ا", "ΣσςİABab", "ababab", " \t\nab'", "  　\xa0a!1", "🙂🙃👍🏽 x", "𝒳\x00\x1c b"]
    texts = ["", "a"]
    for n in range(400):
        letters = "".join(rng.choice(kinds, 3))
        text = "".join(rng.choice(list(letters), rng.integers(1, 300)))
        texts.append(text[:40] + "<|endoftext|>" + text[40:] if n % 3 == 0 else text)
    for leaf in (5, 16, 40):
        found, joins = bpe.tree_encode(texts, path, leaf)
        assert all(t.ids.tolist() == tokenizer.encode(x, add_special_tokens=False).ids for t, x in zip(found, texts))
        assert all((j > 0) == (len(x) > leaf) for j, x in zip(joins, texts))


def test_a_megabyte_without_white_space():
    rng = np.random.default_rng(6)
    path = bpe.default_path()
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz'!09é"), 1_000_000)), "ab" * 500_000, "?" * 1_000_000]
    for text in texts:
        found, joins = bpe.tree_encode([text], path)
        assert found[0].ids.tolist() == bpe.load(path).encode(text, add_special_tokens=False).ids and joins[0] == 511


def test_joins_carry_the_result(real, monkeypatch):
    """Without the windows around the joins the ids of texts above one leaf are wrong; n_joins counts them."""
    rows = bpe.round_trip(real).collect()
    long = {d for d, t in texts_of(real) if len(t) > bpe.LEAF}
    assert long and {r.doc_id for r in rows if r.n_joins} == long
    text = next(t for d, t in texts_of(real) if len(t) > bpe.LEAF)
    right = bpe.tree_encode([text], bpe.default_path(), 64)[0][0].ids.tolist()

    def bare(left, right, *_):
        return bpe.Tokens.concat([left, right])
        yield

    monkeypatch.setattr(bpe, "seam", bare)
    assert bpe.tree_encode([text], bpe.default_path(), 64)[0][0].ids.tolist() != right


def test_bpe_refuses_and_empty(odd):
    good = {"type": "BPE"}
    bpe.check({"model": good, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}})
    for settings in (
        {"model": {"type": "Unigram"}},
        {"model": {"type": "BPE", "dropout": 0.1}},
        {"model": good, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
        {"model": good, "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Strip"}]}},
        {"model": good, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Metaspace"}]}},
    ):
        with pytest.raises(ValueError):
            bpe.check(settings)
    assert bpe.round_trip(odd.limit(0)).count() == 0 and bpe.encode(odd.limit(0)).count() == 0


# --- sketches ---


def test_sketches(odd, real):
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0

    def shingles(t):
        w = WORD.findall(lower(t))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = sorted(texts_of(real), reverse=True)
    got = {r.doc_id: r for r in sketch.edits(real).collect()}
    wrong = []
    for n, (d, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        wrong += [got[d].near_edited - jaccard(shingles(t), shingles(edited)), got[d].near_next - jaccard(shingles(t), shingles(after))]
    assert np.abs(wrong).mean() < 0.03 and np.abs(wrong).max() < 0.2
    found = sketch.edits(odd).collect()
    assert len(found) == odd.count()
    same = {r.fingerprint for r in found if r.doc_id == 7 or r.doc_id == 6}
    assert len(same) == 1 and {r.fingerprint for r in found if r.doc_id in (2, 3, 4)} == {""}
    assert sketch.edits(odd.limit(0)).count() == 0
    assert sketch.edits(odd.where("doc_id = 8")).first().near_next == 1.0


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [" ".join(words[a : a + 1004]) for a in (0, 1000, 2000)]
    df = spark.createDataFrame([("k", p) for p in parts] + [("e", "")], "doc_id string, text string")
    merged = {r.doc_id: np.array(r.sketch, np.uint64) for r in sketch.merge(sketch.sketch(df), "doc_id").collect()}
    whole = sketch.sketches(pa.array([" ".join(words)]))[0]
    assert np.array_equal(merged["k"], whole) and len(merged["e"]) == 0
    assert abs(sketch.distinct_count(whole) / 2996 - 1) < 0.3
    part = sketch.sketches(pa.array([parts[0]]))[0]
    assert sketch.containment(part, whole) > 0.7 and abs(sketch.resemblance(part, whole) - 1 / 3) < 0.15
    assert np.array_equal(sketch.decoded(sketch.encoded(whole)), whole)


# --- language model ---


@pytest.mark.parametrize("table,limit", [("odd", None), ("real", None), ("real", 70_000), ("real", 1)])
def test_language_model(table, limit, request, monkeypatch):
    docs = request.getfixturevalue(table)
    used = []
    inner = lm._scored_by_lots
    monkeypatch.setattr(lm, "_scored_by_lots", lambda *a: used.append(1) or inner(*a))
    monkeypatch.setattr(lm, "SEGMENT_WORDS", 20_000)
    got = lm.score_corpus(docs, broadcast_bytes=limit or lm.BROADCAST_BYTES).collect()
    assert bool(used) == bool(limit)
    tokens = lambda t: [*WORD.findall(lower(t)), "\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in texts_of(docs):
        if not held(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(((str(d), held(d), len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, t in texts_of(docs)), key=lambda x: x[:4])
    found = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda x: x[:4])
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert np.allclose([f[5] for f in found], [w[5] for w in wanted], rtol=1e-9)
    assert all(math.isfinite(f[6]) and f[6] <= 0 for f in found)
    if limit:
        whole = sorted(((str(r.doc_id), r.score) for r in lm.score_corpus(docs).collect()))
        assert np.allclose([x[1] for x in whole], [x[1] for x in sorted((f[0], f[6]) for f in found)])
    if table == "real":
        assert sum(f[6] for f in found if f[1]) > sum(f[5] for f in found if f[1])


def test_log_frequency_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    level = rng.integers(1, 12, len(h))
    f = lm.Filter.of([lm.Filter.segment(h, level)])
    got = f.levels(h)
    assert (got >= level).all() and (got == level).mean() > 0.95
    assert (f.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.05
    counts = np.arange(1, 5000)
    assert (lm.floor_of(lm.level_of(counts)) <= counts).all() and (lm.ceiling_of(lm.level_of(counts)) >= counts).all()


def test_counts_of_pairs_in_few_rows():
    key = np.arange(1, 6, dtype=np.uint64) << np.uint64(8)
    count = np.array([1, 63, 64, 255, 1_000_000])
    rows, own = lm.with_counts(key, count)
    assert len(rows) <= 4 * len(key)
    got = np.zeros(5, np.int64)
    np.add.at(got, own, (rows & np.uint64(63)).astype(np.int64) << 6 * (rows >> np.uint64(6) & np.uint64(3)).astype(np.int64))
    assert got.tolist() == count.tolist() and (rows >> np.uint64(8) == own.astype(np.uint64) + 1).all()


def test_backoff_of_frequent_words():
    # the same follower shares at every size: the weight of p1 must not grow with the counts
    found = []
    for total in (10**5, 10**7, 10**9):
        count = total // 1000
        top = np.uint64(int(lm.level_of(np.array([total]))[0]) << 16 | int(lm.level_of(np.array([count]))[0]) << 8)
        rows = lm.with_counts(np.array([np.uint64(i + 1) << np.uint64(24) | top for i in range(3)]), np.full(3, count))[0]
        part = lm._pair_segment((pa.scalar(0),), pa.table({"rows": pa.array([np.array(rows, np.uint64).tobytes()], pa.binary())}))
        cells = dict(zip(part.column("cells")[0].as_py(), part.column("tokens")[0].as_py()))
        assert sum(cells.values()) == 3 * count
        found.append(lm.fit_backoff(cells, lambda w: np.full(len(w), 1e-4))[int(top) >> 16])
    assert found == [pytest.approx(0.05)] * 3


def test_language_model_of_nothing(odd):
    assert lm.score_corpus(odd.limit(0)).count() == 0


# --- quality, rules ---


def test_quality(spark, sf_dir, odd):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    bad, good = [r.score for r in got if r.quality == 0], [r.score for r in got if r.quality == 1]
    assert np.mean([b < g for b in bad for g in good]) > 0.97
    some = quality.classify(odd, labels).collect()
    assert len(some) == odd.count() and all(0 <= r.score <= 1 for r in some)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in some if r.doc_id is not None)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd, labels)
    assert kept.schema == odd.schema
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


@pytest.mark.parametrize("table", ["odd", "real"])
def test_rules(table, request):
    docs = request.getfixturevalue(table)
    wanted = []
    for d, t in texts_of(docs):
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        wanted.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = rules.judge(docs).collect()
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert not any(r.kept and r.base_failed for r in got) and all(0 <= r.posterior <= 1 for r in got)
    assert rules.judge(docs.limit(0)).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    votes = np.where(rng.random((20_000, 4)) < [0.95, 0.9, 0.85, 0.8], np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    share, tables = rules.em(patterns)
    assert abs(share - 0.8) < 0.03 and abs(tables[0][1][0] - 0.95) < 0.03 and abs(tables[3][-1][1] - 0.8) < 0.05
    assert rules.em([]) == (0.5, [])


# --- shards, mixing ---


@pytest.mark.parametrize("table", ["odd", "real"])
def test_shards(table, request):
    docs = request.getfixturevalue(table)
    rows = sharding.shard_by_bytes(docs, 4).collect()
    texts = Counter((d, zlib.crc32(t.encode()), len(t.encode()) + 1) for d, t in texts_of(docs))
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == texts
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for k in range(4):
        own = sorted((r for r in rows if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) < max(largest, total / 4 / sharding.WHOLE)
    groups = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r.size), []).append(r)
    small = [g for g in groups.values() if sum(r.size for r in g) * 4 * sharding.WHOLE <= total]
    assert small and all(len({r.shard for r in g}) == 1 for g in small)
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_groups_over_many_partitions(spark):
    """A group that goes on over partitions stays whole where it is small, and is cut where it is large."""
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(4000)] + [(6000 + i, "large one " * 20) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_by_bytes(docs, 8, partitions=60).collect()
    total, shards = sum(r.size for r in found), {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    assert all(abs(sum(r.size for r in s) - total / 8) < max(201, total / 8 / sharding.WHOLE) for s in shards.values())
    same = [r.shard for r in found if r.doc_id < 400]
    assert len(set(same)) == 1 or 5 * 400 * 8 * sharding.WHOLE > total


def test_shards_written(spark, real, tmp_path):
    sharding.write_shards(real, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == real.count()


@pytest.mark.parametrize("table", ["odd", "real"])
def test_mixing(table, request):
    docs = request.getfixturevalue(table)
    rows = sorted(mixing.mix(docs, block_rows=2).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(docs.count()))
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in docs.collect())
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    ordered = mixing.in_order(docs)
    assert ordered.schema == docs.schema and ordered.count() == docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_keeps_to_fair_shares():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {i: int(rng.choice([0, 1, 2, 5, 30, 100])) for i in range(rng.integers(1, 8))}
        weights = mixing.target_weights(counts, {i: float(rng.random() ** 3 + 0.001) for i in counts})
        spans = {(s, k): (a, b) for a, b, s, k in mixing.windows(counts, weights)} if any(counts.values()) else {}
        plan = mixing.schedule(counts, weights) if spans else []
        assert [x[2] for x in plan] == list(range(sum(counts.values())))
        assert all(spans[s, k][0] <= slot < spans[s, k][1] for s, k, slot in plan)


def test_mixing_two_sources():
    plan = mixing.schedule({"a": 30, "b": 10}, mixing.target_weights({"a": 30, "b": 10}, {"a": 3, "b": 1}))
    for t in range(1, 41):
        assert abs(sum(s == "a" for s, _, slot in plan if slot < t) - 0.75 * t) < 1


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_words_are_cut_at_ascii_white_space_only():
    from marlpit.llm.text import slices, split_words

    texts = ["".join(f"{chr(c)}a" for c in range(300)), "\x1c\x1d x\x1f y\x85\xa0z q ", "　a\x0b\x0cb", "a\x00b c", "", None]
    flat, off = split_words(next(slices(pa.array(texts)))[1])
    assert [flat.slice(a, b - a).to_pylist() for a, b in zip(off[:-1], off[1:])] == [WORD.findall(t or "") for t in texts]
    assert [at for at, _ in slices(pa.array(["x" * 10] * 5), 25)] == [0, 2, 4]


def test_bpe_keeps_words_from_slice_to_slice(monkeypatch):
    path = bpe.default_path()
    texts = pa.array([f"one two thrée word{i % 7} {'z' * (i % 5)}" for i in range(200)])
    whole = [ids.tolist() for _, ids, _, _ in bpe.encode_texts(texts, path)]
    asked, known = [], bpe.KnownWords(bpe.load(path))
    arrays = bpe._arrays
    monkeypatch.setattr(bpe, "known_words", lambda path: known)
    monkeypatch.setattr(bpe, "_arrays", lambda tokenizer, words, few: asked.extend(words) or arrays(tokenizer, words, few))
    monkeypatch.setattr(bpe, "STEP_BYTES", 300)
    assert [i for _, ids, _, _ in bpe.encode_texts(texts, path) for i in ids.tolist()] == sum(whole, [])
    assert len(asked) == len(set(asked)) == 14
    monkeypatch.setattr(bpe, "KEPT", 3)  # beyond that the words are forgotten
    assert [i for _, ids, _, _ in bpe.encode_texts(texts, path) for i in ids.tolist()] == sum(whole, [])
    assert len(asked) > 14 and len(known.words) <= 3 + 14


def test_bpe_keeps_the_words_of_the_most_slices(monkeypatch):
    """When more words come than are kept, frequent ones aren't encoded again and again."""
    path = bpe.default_path()
    common = [f"{a}{b}" for a in "abcdé" for b in "vwxyz"]
    texts = pa.array([" ".join([*common, *(f"rare{i}x{k}" for k in range(20))]) for i in range(40)])
    whole = [ids.tolist() for _, ids, _, _ in bpe.encode_texts(texts, path)]
    asked, known = [], bpe.KnownWords(bpe.load(path))
    arrays = bpe._arrays
    monkeypatch.setattr(bpe, "known_words", lambda path: known)
    monkeypatch.setattr(bpe, "_arrays", lambda tokenizer, words, few: asked.extend(words) or arrays(tokenizer, words, few))
    monkeypatch.setattr(bpe, "STEP_BYTES", 300)
    for points in (bpe.KEPT_POINTS, 400):
        monkeypatch.setattr(bpe, "KEPT_POINTS", points)
        monkeypatch.setattr(bpe, "KEPT", 60 if points > 400 else 1000)
        assert [i for _, ids, _, _ in bpe.encode_texts(texts, path) for i in ids.tolist()] == sum(whole, [])
        assert len(known.words) <= 60 + 45
    assert all(asked.count(w) == 1 for w in common) and len(asked) == len(common) + 2 * 800
