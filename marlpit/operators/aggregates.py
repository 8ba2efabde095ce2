"""Aggregates beyond Spark's own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(x: Column) -> Column:
    """sum() as a double, 0.0 of nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: str = ",", order: Column | None = None) -> Column:
    """Texts joined in order (of `order`, or of themselves); nulls are left out."""
    key = x if order is None else order
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(key.alias("k"), x.cast("string").alias("x")))))
    return F.when(F.count(x) > 0, F.concat_ws(separator, F.transform(pairs, lambda p: p["x"])))


def json_group_array(x: Column, order: Column) -> Column:
    """A JSON array of all values in order, nulls too."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), x.alias("x"))))
    return F.to_json(F.transform(pairs, lambda p: p["x"]))


def json_group_object(k: Column, v: Column) -> Column:
    """A JSON object of keys, in their order, and values; rows with a null key are left out, of equal keys the greatest value stays."""
    pairs = F.array_sort(F.collect_list(F.when(k.isNotNull(), F.struct(k.cast("string").alias("k"), v.alias("v")))))
    last = F.filter(pairs, lambda p, i: ~F.coalesce(F.get(pairs, i + 1)["k"] == p["k"], F.lit(False)))
    return F.coalesce(F.to_json(F.map_from_entries(last)), F.lit("{}"))


def percentile_cont(x: Column, p: float) -> Column:
    """Linear interpolation between the two nearest values."""
    return F.percentile(x, p)


def percentile_per_group(df: DataFrame, keys: list[str], column: str, p: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, name): percentile_cont of large groups, exactly. A sketch brackets the place of the percentile; values below
    are only counted, and those within, some 4 / accuracy of the group, are counted by value and put in order. Groups of
    at most 4 * accuracy values are bracketed by their ends, groups without values have null."""
    e, x = 2.0 / accuracy, F.col(column)
    edges = F.percentile_approx(x, [max(0.0, p - e), min(1.0, p + e)], accuracy)
    found = df.groupBy(*keys).agg(edges.alias("__mp_e"), F.count(x).alias("__mp_n"), F.array(F.min(x), F.max(x)).alias("__mp_ends"))
    found = found.withColumn("__mp_e", F.when(F.col("__mp_n") <= 4 * accuracy, F.col("__mp_ends")).otherwise(F.col("__mp_e"))).drop("__mp_ends")
    rows = df.select(*(F.col(k).alias(f"__mp_{k}") for k in keys), x.alias("__mp_x")).where("__mp_x is not null")
    place = (F.col("__mp_n") - 1) * F.lit(p)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__mp_{k}").eqNullSafe(F.col(k))
    near = rows.join(found, on).where(F.col("__mp_x") <= F.col("__mp_e")[1])
    by = [F.col(k) for k in keys]
    counts = near.groupBy(*by, "__mp_n", F.when(F.col("__mp_x") >= F.col("__mp_e")[0], F.col("__mp_x")).alias("__mp_v")).agg(F.count("*").alias("__mp_c"))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first("__mp_v"))
    counts = counts.withColumn("__mp_s", F.sum("__mp_c").over(w))
    low, high = F.floor(place), F.ceil(place)
    wrong = F.raise_error(F.lit("the sketch misses the percentile"))
    inside = counts.groupBy(*by, "__mp_n").agg(
        F.min(F.when(F.col("__mp_s") > low, F.col("__mp_v"))).alias("a"),
        F.min(F.when(F.col("__mp_s") > high, F.col("__mp_v"))).alias("b"),
        F.coalesce(F.max(F.when(F.col("__mp_v").isNull(), F.col("__mp_c"))), F.lit(0)).alias("below"),
    )
    value = F.when(low == high, F.col("a").cast("double")).otherwise((high - place) * F.col("a") + (place - low) * F.col("b"))
    inside = inside.select(*by, F.when((F.col("below") > low) | F.col("b").isNull(), wrong.cast("double")).otherwise(value).alias(name))
    whole = found.select(*(F.col(k).alias(f"__mp_{k}") for k in keys))
    return whole.join(inside, on, "left").select(*(F.col(f"__mp_{k}").alias(k) for k in keys), name)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__mp_n", F.row_number().over(w)).where("__mp_n = 1").drop("__mp_n")


def first_of_group(df: DataFrame, keys: list[str], columns: list[str], by: Column) -> DataFrame:
    """Bare columns beside a grouping: their values in the group's first row by `by`. One pass with map-side combining."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), by).alias("__mp_s")).select(*keys, "__mp_s.*")
