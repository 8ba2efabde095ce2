"""WARC packages, the pipeline, and the SQL twins of the operators' queries."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlpit.llm import queries, warc
from marlpit.sources.tables import TABLES


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = c.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, sf_dir).select(*wanted.columns)
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b\n", "x" * 150), (1, None, "x" * 150), (1, None, "x" * 150), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (None, "u", "né" * 80), (7, "u", "y" * 5_000_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()}
    assert got[1, 150] == ("response", None) and got[3, 150] == ("revisit", 1)
    assert got[2, 99] == got[4, 99] == got[5, 0] == got[6, 0] == ("response", None)
    assert got[None, 240] == ("response", None) and got[7, 5_000_000] == ("response", None)
    assert warc.round_trip(spark, pages).count() == len(rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(tmp_path, zip64):
    path = str(tmp_path / "x.zip")
    with open(path, "wb") as f:
        assert warc.write_package(f, iter([(i, "u", b"body%d" % i, "0" * 64, None) for i in range(5)]), zip64=zip64) == 5
    with zipfile.ZipFile(path) as z, pa.OSFile(path) as f:
        found = warc.members(f, f.size())
        assert set(found) == set(z.namelist())
        for name, (at, size, method) in found.items():
            assert method == 0 and f.read_at(size, at) == z.read(name)


def test_zip64_end_records():
    """A directory whose classic end record overflows is read from its ZIP64 form."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"%d" % i)
    f = pa.BufferReader(out.getvalue())
    found = warc.members(f, f.size())
    assert len(found) == 66_000
    at, size, _ = found["m65999"]
    assert f.read_at(size, at) == b"65999"


def test_package_of_another_writer(spark, tmp_path):
    """Several archives, a gzipped CDXJ index with SURT keys, string offsets, UUIDs, SHA-1 digests, other record kinds."""
    body = b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()

    def record(kind, name, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Target-URI: http://www.example.org/a?b=1", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    response = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    first = [record("warcinfo", "i", b"software: x\r\n"), record("response", "r", response, f"WARC-Payload-Digest: sha1:{sha1}")]
    second = [record("request", "q", b"GET / HTTP/1.1\r\n\r\n"), record("response", "s", response), record("revisit", "v", b"HTTP/1.1 200 OK\r\n\r\n", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:r>")]
    lines = ["!meta {}"]
    for name, parts in (("one.warc.gz", first), ("two.warc.gz", second)):
        at = 0
        for p in parts:
            lines.append(f"org,example)/a?b=1 20240101000000 {json.dumps({'filename': name, 'offset': str(at), 'length': str(len(p))})}")
            at += len(p)
    path = str(tmp_path / "other.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr("archive/two.warc.gz", b"".join(second))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
        z.writestr("archive/one.warc.gz", b"".join(first))
    rows = sorted(tuple(r) for r in warc.read(spark.createDataFrame([(path,)], "path string")).select("payload_bytes", "payload_digest", "record_type", "url").collect())
    url = "http://www.example.org/a?b=1"
    assert rows == sorted([(12, sha1, "response", url), (12, hashlib.sha256(body).hexdigest(), "response", url), (0, sha1, "revisit", url)])
    assert warc.surt("http://www.Example.org/A?b=1") == "org,example)/a?b=1"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/one.warc.gz", b"".join(first))
    with pytest.raises(Exception, match="no index"):
        warc.read(spark.createDataFrame([(path,)], "path string")).collect()


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "source_mixing", "bpe_encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, sf_dir)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [r.doc_id in ids for r in labels.where("quality = 1").collect()]
    assert kept.schema == docs.schema and sum(good) >= 0.97 * len(good)
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "slot", "position"]
    assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= ids
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_takes_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).withColumn("id", F.lit(1)).withColumn("fp", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
