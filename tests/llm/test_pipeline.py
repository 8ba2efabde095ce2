"""The pipeline as a whole."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from marlpit.llm import bpe, mixing
from test_texts import simhash_by_hand, substrings_by_hand, texts_of


def test_mixed_order_survives_files(spark, sf_dir, tmp_path, monkeypatch):
    written = {}
    inner = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: written.setdefault(name, inner(df, name)))
    monkeypatch.setattr(mixing.places, "__defaults__", (None, 4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus_pipeline.run(spark, sf_dir).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = spark.read.parquet(str(tmp_path / "out"))
    mixed = written["pipeline-source_mixing"]
    assert len(found.inputFiles()) > 1 and len(mixed.inputFiles()) > 1
    rows = defaultdict(list)
    for r in mixed.select("doc_id", "source", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.xxhash64("doc_id", "text")), 1).alias("key")).collect():
        rows[r.source].append((r.key, r.doc_id))
    counts = {s: len(x) for s, x in rows.items()}
    plan = mixing.schedule({s: -(-n // 4) for s, n in counts.items()}, mixing.target_weights(counts))
    wanted = [(d, slot) for s, k, slot in plan for _, d in sorted(rows[s])[4 * k : 4 * k + 4]]
    got = sorted(found.collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(mixed.count()))
    assert [(r.doc_id, r.slot) for r in got] == wanted
    ids = {r.doc_id: (r.n_tokens, r.ids, r.ids_sha256) for r in bpe.encode(mixed).collect()}
    assert all((r.n_tokens, r.ids, r.ids_sha256) == ids[r.doc_id] for r in got)


def test_rows_by_hand(spark, sf_dir, monkeypatch):
    written = {}
    inner = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: written.setdefault(name, inner(df, name)))
    found = sorted((r.doc_id, r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect())
    first = texts_of(written["pipeline-quality_classifier"])
    one = {d for d, _, low in simhash_by_hand(first) if d == low}
    left = [(d, t) for d, t in first if d in one]
    cut = {d: text for d, _, gone, text in substrings_by_hand(left) if gone}
    assert len(left) < len(first) and cut
    tokenizer = bpe.load(bpe.default_path())
    ids = {d: tokenizer.encode(cut.get(d, t), add_special_tokens=False).ids for d, t in left}
    assert found == sorted((d, len(i), i) for d, i in ids.items())
