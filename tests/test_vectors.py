"""Searches for many query vectors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlpit.functions import vector_blocks, vectors
from marlpit.plans import catalogue


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_lsh(spark, sf_dir, sf):
    path = sf_dir.replace("sf0.001", sf)
    n = spark.read.parquet(f"{path}/embeddings.parquet").where("vec_id % 50 = 0").count()
    found = [(r.query_id, r.vec_id) for r in catalogue.QUERIES["vec_lsh"](spark, path).collect()]
    wanted = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vec_l2_topk_all"](spark, path).where("rank <= 10").collect()}
    assert len(wanted) == 10 * n and list(Counter(q for q, _ in found).values()) == [10] * n
    recall = len(wanted & set(found)) / len(wanted)
    print("recall", sf, recall)
    assert recall >= 0.9


def test_lsh_always_finds_k(spark):
    # far apart: no bucket is shared, each query is answered exactly
    rows = spark.createDataFrame([(i, [1000.0 * i * i, -777.0 * i]) for i in range(30)] + [(50, None)], "vec_id long, embedding array<float>")
    asked = rows.where(F.col("vec_id") % 10 == 0)
    got = vectors.nearest_all_by_hash(rows, asked, 5, bucket=0.01)
    wanted = vectors.nearest_all(rows, asked, 5)
    assert sorted(got.collect()) == sorted(wanted.collect()) and wanted.count() == 15


@pytest.mark.parametrize("name", ["vec_l2_topk_all", "vec_cosine_topk_all", "vec_ip_topk_all", "vec_lsh"])
def test_searches_build_no_table_of_pairs(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("metric", [vectors.l2, vectors.cosine, vectors.inner_product_distance])
def test_blocks_find_what_all_pairs_do(spark, monkeypatch, metric):
    # copies, ties, nulls, several dimensions, numbers that are none: distances to the last bit, over several blocks
    inf, nan = float("inf"), float("nan")
    kinds = [[float((i * j) % 5 - 2), i / 7.0, -1.0 * (i % 3)] for i in range(40) for j in (1, 3)]
    odd = [None, [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 0.0, 1.0], [-inf, 1.0, 0.0], [0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 2.0], [], [], [1e38, 1e38, 0.0], kinds[0]]
    rows = [*((i, kinds[i * i % 80]) for i in range(400)), *((1000 + i, v) for i, v in enumerate(odd)), (7, kinds[1]), (None, kinds[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 50 = 0 or vec_id >= 1000")
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 600)
    monkeypatch.setattr(vector_blocks, "PAIRS", 50)
    found = vectors.nearest_all(df, asked, 5, metric).collect()
    wanted = vectors.nearest_all(df, asked, 5, lambda a, b: metric(a, b)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, wanted)) and len(wanted) > 50
