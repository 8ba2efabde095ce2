"""Window frames that Spark has no syntax for: GROUPS, and EXCLUDE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from marlpit.session import cut_lineage


def groups_frame(df: DataFrame, partition: list[str], order: str, before: int, after: int, **found: Column) -> DataFrame:
    """Aggregates over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a range over the rank of peers."""
    ranked = df.withColumn("__mp_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)).cast("bigint"))
    w = Window.partitionBy(*partition).orderBy("__mp_g").rangeBetween(-before, after)
    return ranked.select(*df.columns, *(c.over(w).alias(k) for k, c in found.items()))


def sum_excluding(value: str, row_id: str, frame: WindowSpec, exclude: str, peer: str | None = None) -> Column:
    """sum(value) over a frame of rows, EXCLUDE CURRENT ROW, GROUP or TIES; peers share `peer`. Null over nothing.

    The frame's rows are gathered, so frames should be short; nothing is subtracted, so doubles stay exact sums.
    """
    item = F.struct(F.col(row_id).alias("i"), F.col(peer or row_id).alias("p"), F.col(value).alias("v"))
    rows = F.collect_list(item).over(frame)
    own_id, own_peer = F.col(row_id), F.col(peer or row_id)
    keep = {
        "current row": lambda r: r["i"] != own_id,
        "group": lambda r: ~r["p"].eqNullSafe(own_peer),
        "ties": lambda r: (r["i"] == own_id) | ~r["p"].eqNullSafe(own_peer),
        "no others": lambda r: F.lit(True),
    }[exclude.lower()]
    kept = F.filter(F.filter(rows, keep), lambda r: r["v"].isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, r: a + r["v"]))


def sum_excluding_peers(value: str, partition: list[str], peer: str, ties_only: bool = False, scale: int = 6) -> Column:
    """sum(value) over the whole partition, EXCLUDE GROUP (or TIES): the partition's sum without the peers' (but the row's own).

    Sums are decimals of `scale` places, so that taking away is exact; nothing is gathered. Null over nothing.
    """
    x = F.col(value).cast(f"decimal(28,{scale})")
    whole, peers = Window.partitionBy(*partition), Window.partitionBy(*partition, peer)
    own = F.coalesce(x, F.lit(0)) if ties_only else F.lit(0)
    left = F.count(x).over(whole) - F.count(x).over(peers) + (x.isNotNull().cast("int") if ties_only else F.lit(0))
    return F.when(left > 0, (F.coalesce(F.sum(x).over(whole), F.lit(0)) - F.coalesce(F.sum(x).over(peers), F.lit(0)) + own).cast("double"))


def rank_over_all(df: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """df with rank() over all its rows by one column: rows of each value are counted, and the values' counts summed
    in range partitions with each partition's total before; no task sees all rows. Nulls come last."""
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(column).agg(F.count("*").alias("__mp_n"))
    # the partition a value falls in is written down: totals and sums must see the same ones
    counts = cut_lineage(counts.repartitionByRange(parts, order).withColumn("__mp_p", F.spark_partition_id()))
    totals = counts.groupBy("__mp_p").agg(F.sum("__mp_n").alias("__mp_t"))
    before = totals.select("__mp_p", (F.sum("__mp_t").over(Window.orderBy("__mp_p")) - F.col("__mp_t")).alias("__mp_b"))  # a row per partition
    inside = F.sum("__mp_n").over(Window.partitionBy("__mp_p").orderBy(order)) - F.col("__mp_n")
    ranks = counts.withColumn("__mp_i", inside).join(F.broadcast(before), "__mp_p")
    ranks = ranks.select(F.col(column).alias("__mp_v"), (F.col("__mp_b") + F.col("__mp_i") + 1).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("__mp_v"))).drop("__mp_v")


def total_over(x: Column, frame: WindowSpec) -> Column:
    return F.coalesce(F.sum(x.cast("double")).over(frame), F.lit(0.0))


def count_distinct_over(df: DataFrame, value: str, partition: list[str], name: str) -> DataFrame:
    """df with name: count(DISTINCT value) OVER (PARTITION BY partition), nulls not counted.

    Values are counted by an aggregate, combined before the shuffle, and joined back; null keys are a partition too.
    """
    found = df.groupBy(*partition).agg(F.countDistinct(value).alias(name))
    found = found.select(*(F.col(c).alias(f"__of_{c}") for c in partition), name)
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in partition]
    return df.join(found, on).drop(*(f"__of_{c}" for c in partition))
