"""The queries themselves, as registered, against plain versions of what they compute."""

import base64
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

from marlpit.llm import lm, mixing, quality, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_op1(spark, sf_dir, rows):
    """score: the same model on exact tables of levels, and near the model of the exact counts themselves."""
    got = {r.doc_id: r for r in queries.op1_lm(spark, sf_dir).collect()}
    tokens = {d: [*WORD.findall(lower(t)), "\n"] for d, t in rows}
    train = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    words, pairs = Counter(), Counter()
    for d in train:
        words.update(tokens[d])
        pairs.update(zip(["\n", *tokens[d][:-1]], tokens[d]))
    level = lambda n: int(lm.level_of(np.array([n]))[0])
    kinds = Counter(map(level, words.values()))
    discount = kinds[1] / (kinds[1] + 2 * kinds[2])
    floor = lambda q: float(lm.floor_of(np.array([q]))[0])
    ceiling = lambda q: float(lm.ceiling_of(np.array([q]))[0])
    model = lm.Model(None, None, None, discount, len(words), sum(floor(q) * n for q, n in kinds.items()))
    cells = Counter()
    for (v, w), n in pairs.items():
        cells[(level(words[v]) << 8 | level(words[w])) * lm.PAIR_LEVELS + level(n)] += n
    backoff = lm.fit_backoff(cells, model.p1)
    p1 = lambda q: float(model.p1(np.array([q]))[0])
    off, exact, total = [], [], sum(words.values())
    for d, t in tokens.items():
        score = plain = 0.0
        for v, w in zip(["\n", *t[:-1]], t):
            qv, qw = level(words[v]), level(words[w])
            b = backoff[qv]
            seen = min(floor(level(pairs[v, w])) / ceiling(qv), 1) if qv and qw else 0
            score += math.log10((1 - b) * seen + b * p1(qw))
            real = pairs[v, w] / words[v] if words[v] else 0
            plain += math.log10((1 - b) * real + b * ((words[w] - discount) / total if words[w] else discount * len(words) / total))
        off.append((got[d].score - score) / len(t))
        exact.append((got[d].score - plain) / len(t))
    # one probe in 2 ** PROBES hits wrongly and raises a level, by about a power of ten where it is the first; floors are
    # at most a fifth below the counts. A short text may hold a wrong hit often, so all tokens are looked at together.
    size = np.array([len(t) for t in tokens.values()])
    assert np.abs(off) @ size / size.sum() < 2 / 2**lm.PROBES
    assert np.abs(exact) @ size / size.sum() < 0.15


def test_op2(spark, sf_dir):
    got = sorted(queries.op2_mixing(spark, sf_dir).collect(), key=lambda r: r.position)
    key = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.xxhash64("doc_id", "text")), 1)
    own = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", key.alias("key")).collect():
        own.setdefault(r.source, []).append((r.key, r.doc_id))
    counts = {s: len(x) for s, x in own.items()}
    size = max(1, -(-sum(counts.values()) // mixing.BLOCKS))
    plan = mixing.schedule({s: -(-n // size) for s, n in counts.items()}, mixing.target_weights(counts))
    wanted = [(d, s, k, slot) for s, k, slot in plan for _, d in sorted(own[s])[size * k : size * (k + 1)]]
    assert [(r.doc_id, r.source, r.block, r.slot) for r in got] == wanted
    assert [r.position for r in got] == list(range(len(wanted)))
    # at any slot a source is less than a block from its fair share while all sources last
    share = {s: float(w) for s, w in mixing.target_weights(counts).items()}
    whole, first_end = sum(share.values()), min(counts[s] / share[s] for s in counts)
    seen = Counter()
    for n, (_, s, _, _) in enumerate(wanted, 1):
        seen[s] += 1
        if n / whole < first_end:
            assert all(abs(seen[x] - n * share[x] / whole) < size for x in share)


def test_mixing_refuses_too_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 4)
    docs = spark.createDataFrame([(i, "t", "s") for i in range(20)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(docs, block_rows=2)


def test_op4(spark, sf_dir, rows):
    """Scores: the normal equations over all rows at once, in plain numpy."""
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf_dir).collect()}
    x = dict(zip((d for d, _ in rows), quality.statistics(pa.array([t for _, t in rows]))))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))).collect()
    used = [(x[r.doc_id], r.quality, r.fold) for r in labels if r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    a, y, fold = np.array([u[0] for u in used]), np.array([u[1] for u in used], float), np.array([u[2] for u in used])
    rng, d, size = np.random.default_rng(7), len(quality.NAMES), 257
    directions, phases = rng.normal(0, 1 / np.sqrt(d), (d, 256)), rng.uniform(0, 2 * np.pi, 256)
    scale = a.std(0)
    features = lambda v: np.column_stack([np.sqrt(2 / 256) * np.cos(np.clip((v - a.mean(0)) / np.where(scale > 1e-9, scale, 1), -5, 5) @ directions + phases), np.ones(len(v))])
    z = features(a)
    solve = lambda s: np.linalg.solve(z[s].T @ z[s] + 1e-3 * len(y) * np.eye(size) / size, z[s].T @ y[s])
    raw = np.array([z[i] @ w for i, w in ((i, solve(fold != fold[i])) for i in range(len(y)))])
    at = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    curve = quality.isotonic(*(np.array([f(at == b) for b in bins]) for f in (lambda s: raw[s].mean(), lambda s: y[s].mean(), lambda s: float(s.sum()))))
    weights = solve(np.ones(len(y), bool))
    wanted = np.clip(np.interp(features(np.array([x[d] for d, _ in rows])) @ weights, *curve), 0, 1)
    assert np.allclose([got[d].score for d, _ in rows], wanted, atol=1e-6)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_of_no_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.held_out for r in quality.classify(docs, labels).collect()}[None] is False


def test_op5(spark, sf_dir, rows):
    """kept: votes, expectation-maximisation and posterior in plain numpy, over rows and not patterns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    votes = rules.statistics(docs).select("id", *(v.alias(k) for k, v in rules.votes().items())).collect()
    got = {r.doc_id: r for r in queries.op5_rules(spark, sf_dir).collect()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got.values())
    ids, v = [r[0] for r in votes], np.array([r[1:] for r in votes])
    ok = np.array([not got[i].base_failed for i in ids])
    good = np.where((v[ok] == -1).any(1), 0.1, 0.9)
    for _ in range(100):
        share = (good.sum() + 1) / (len(good) + 2)
        g = np.array([[(good[v[ok][:, j] == k].sum() + 1) / (good.sum() + 3) for k in (-1, 0, 1)] for j in range(v.shape[1])])
        b = np.array([[((1 - good)[v[ok][:, j] == k].sum() + 1) / ((1 - good).sum() + 3) for k in (-1, 0, 1)] for j in range(v.shape[1])])
        odds = lambda votes: np.log(share / (1 - share)) + np.log(g / b)[np.arange(v.shape[1]), votes + 1].sum(1)  # noqa: B023, E731
        new = 1 / (1 + np.exp(-odds(v[ok])))
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-9:
            break
    wanted = 1 / (1 + np.exp(-odds(v)))
    assert np.allclose([got[i].posterior for i in ids], wanted, atol=1e-6)
    assert all(got[i].kept == (not got[i].base_failed and p >= 0.5) for i, p in zip(ids, wanted) if abs(p - 0.5) > 1e-6)


def test_repeats_in_a_very_long_text(spark):
    """200,000 words whose windows are nearly all different: not one false repeat."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 300, 200_000)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    found = rules.statistics(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert found.n_repeat_words == len(covered)


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def sketch_by_hand(text, k=128):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(lower(text))]
    grams = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        out = 0
        for x in h[i : i + 5]:
            out = (out + x) * 0x9E3779B97F4A7C15 & M64
            out ^= out >> 29
        grams.add(mixed(out) >> 1)
    return sorted(grams)[:k]


def test_op9(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.op9_sketch(spark, sf_dir).collect()}
    ordered = sorted(rows, reverse=True)
    for n, (d, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        own, new, after = map(sketch_by_hand, (t, edited, following))
        text = lambda s: base64.b64encode(b"".join(x.to_bytes(8, "big") for x in s)).decode()
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (text(own), text(new))

        def alike(a, b):
            if not a or not b:
                return float(len(a) == len(b))
            few = sorted(set(a) | set(b))[: 128 if max(len(a), len(b)) >= 128 else None]
            return len(set(few) & set(a) & set(b)) / len(few)

        assert got[d].near_edited == pytest.approx(alike(own, new)) and got[d].near_next == pytest.approx(alike(own, after))


def test_op7_and_op10(spark, sf_dir, rows):
    from test_texts import simhash_by_hand

    from marlpit.llm import bpe

    assert sorted(map(tuple, queries.op7_simhash(spark, sf_dir).collect()), key=str) == simhash_by_hand(rows)
    tokenizer = bpe.load(bpe.default_path())
    got = {r.doc_id: r for r in queries.op10_bpe(spark, sf_dir).collect()}
    for d, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
