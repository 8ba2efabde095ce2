"""Balanced contiguous shards from global byte-size prefix sums. DataFrame operations only.

Rows are put in the order of (MD5 of the text, id) over range partitions, so that equal texts are neighbours; each
partition's total gives the sum before it, a running sum inside the partition gives every row's own place in the
bytes of the whole table, and the table is cut at equal targets (total / shards). A group of equal texts of at most
1 in WHOLE of the target goes where its first row goes, so it stays in one shard; larger groups are cut like other rows,
or a group of a third of all rows would fill shards alone. A shard differs from the target by less than 1 in WHOLE of
it, or its largest row.

Size: UTF-8 bytes of the text plus 1; a null text has size 1 and checksum 0, as an empty one. Null ids come first
within their group; rows that repeat in id and text are alike, so any of their orders gives the same result. An empty
table gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlpit.llm.text import materialize

WHOLE = 32


def shard_by_bytes(docs: DataFrame, shards: int = 8, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size long, text_crc32 long, shard int, slot long): slot counts from 0 within the shard, without gaps."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    order = ["h", "id", "tie"]
    # the part a row falls in is written down: totals and running sums must see the same parts
    rows = materialize(rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "sized")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = totals.withColumn("bytes_before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("bytes").over(Window.partitionBy()))
    starts = materialize(totals, "parts")
    # groups that go on from one partition to the next: fewer than there are partitions
    edges = starts.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("h")).groupBy("h").agg(F.count("*").alias("parts")).where("parts > 1").select("h")
    wide = rows.join(F.broadcast(edges), "h").groupBy("h", "part").agg(F.sum("size").alias("own"))
    wide = wide.join(F.broadcast(starts.select("part", "bytes", "bytes_before")), "part").groupBy("h")
    wide = wide.agg(F.sum("own").alias("wide_bytes"), F.min_by(F.col("bytes_before") + F.col("bytes") - F.col("own"), "part").alias("wide_at"))
    own = Window.partitionBy("part").orderBy(*order)
    placed = rows.withColumn("at", F.sum("size").over(own) - F.col("size")).withColumn("rank", F.row_number().over(own) - 1)
    group = Window.partitionBy("part", "h")
    placed = placed.withColumn("group_at", F.min("at").over(group)).withColumn("group_bytes", F.sum("size").over(group))
    placed = placed.join(F.broadcast(starts.select("part", "bytes_before", "rows_before", "total")), "part").join(F.broadcast(wide), "h", "left")
    group_at = F.coalesce("wide_at", F.col("bytes_before") + F.col("group_at"))
    place = F.when(F.coalesce("wide_bytes", "group_bytes") * (shards * WHOLE) <= F.col("total"), group_at).otherwise(F.col("bytes_before") + F.col("at"))
    placed = placed.withColumn("place", place).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"place * {shards} div total").cast("int")))
    placed = placed.select("id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("rank")).alias("rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as shard=0, shard=1, ... below path; rows with one id and text stay together in the first of their shards."""
    places = shard_by_bytes(docs, shards, None, id_col, text_col).groupBy(F.col(id_col).alias("__mp_id"), F.col("text_crc32").alias("__mp_crc")).agg(F.min("shard").alias("shard"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    docs.join(places, docs[id_col].eqNullSafe(places["__mp_id"]) & (crc == places["__mp_crc"])).drop("__mp_id", "__mp_crc").repartition(shards, "shard").write.partitionBy("shard").parquet(path)
