"""Vector distances as higher-order expressions, exact and approximate nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.functions import vector_blocks
from marlpit.session import cut_lineage

#: Numbers in a block of rows at most, and rows at least where there are cores without work.
BLOCK_NUMBERS, BLOCK_ROWS = 8 << 20, 4096


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(_products(a, b))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance; null where a vector has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size)


def dims(a: Column) -> Column:
    return F.size(a)


def from_text(x: Column) -> Column:
    """A vector from JSON text."""
    return F.from_json(x, "array<float>")


def nearest(df: DataFrame, query: list[float], k: int, metric=l2, vector: str = "embedding") -> DataFrame:
    """The k rows nearest to a query: each partition keeps k, then the best of those."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.withColumn("distance", metric(F.col(vector), q)).orderBy("distance", df.columns[0]).limit(k)


def nearest_by_hash(df: DataFrame, query: list[float], k: int, bucket: float = 2.0, tables: int = 8, vector: str = "embedding", seed: int = 11) -> DataFrame:
    """k rows near to a query, approximately: random projection buckets, then exact distances inside them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance").drop("__v", "__h")


def _k_best(pairs: DataFrame, k: int) -> DataFrame:
    # each task keeps k of its rows for a query, then the best of those
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return best.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def _pairs_near(rows: DataFrame, queries: DataFrame, k: int, metric, planes: list[list[float]] | None = None, bucket: float = 1.0) -> DataFrame:
    """(query_id, vec_id, distance): of each block of rows the k nearest to each query. Every pair is looked at.

    Rows go once to the task of their block, with a copy of the queries for each block: a task holds its rows and reads the queries.
    """
    n, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * max(dim or 0, 1) // BLOCK_NUMBERS), min(4 * rows.sparkSession.sparkContext.defaultParallelism, n // BLOCK_ROWS))
    own = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), "vec_id", "embedding")
    dealt = own.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asked")
    kind = rows.schema["vec_id"].dataType.simpleString()
    return dealt.mapInArrow(vector_blocks.search(k, metric, planes, bucket), f"query_id {kind}, vec_id {kind}, distance double")


def nearest_all(rows: DataFrame, queries: DataFrame, k: int, metric=l2) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k rows nearest to every query, both (vec_id, embedding). Without a distance: no row.

    l2, cosine and inner_product_distance go by blocks; the pairs of another metric are measured one by one.
    """
    blockwise = {l2: vector_blocks.L2, cosine: vector_blocks.Cosine, inner_product_distance: vector_blocks.InnerProduct}
    if metric in blockwise:
        return _k_best(_pairs_near(rows, queries, k, blockwise[metric]()), k)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("__q"))
    pairs = rows.crossJoin(asked).select("query_id", "vec_id", metric(F.col("embedding"), F.col("__q")).alias("distance"))
    return _k_best(pairs.where(F.col("distance").isNotNull()), k)


def nearest_all_by_hash(rows: DataFrame, queries: DataFrame, k: int, bucket: float = 2.0, tables: int = 8, seed: int = 11) -> DataFrame:
    """nearest_all by l2, approximately: exact distances of the pairs that share a random projection bucket in some table.

    Every pair's buckets are compared, where its distance may count. A query that finds fewer than k rows so is answered exactly.
    """
    from random import Random

    first = rows.where(F.size("embedding") > 0).select(F.size("embedding")).first()  # one row: the dimension
    draw = Random(seed)
    planes = [[draw.gauss(0, 1) for _ in range(first[0] if first else 0)] for _ in range(tables)]
    found = cut_lineage(_k_best(_pairs_near(rows, queries, k, vector_blocks.L2(), planes, bucket), k))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    rest = cut_lineage(queries.join(full, "vec_id", "left_anti"))
    if rest.isEmpty():
        return found
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(nearest_all(rows, rest, k))
