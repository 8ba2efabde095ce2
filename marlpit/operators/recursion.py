"""Recursive queries that drop repeats: the UNION form, which Spark's own recursion doesn't take."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from marlpit.session import shared_folder


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """start, and step(new rows) again and again until a round finds nothing that wasn't there.

    A round writes its new rows alone; what was there is the folders of all rounds, read together.
    """
    spark, schema = start.sparkSession, start.schema
    folder = f"{shared_folder(spark)}/recursion-{uuid.uuid4().hex}"
    rows, rounds = start.distinct(), []
    for n in range(limit):
        rows.write.parquet(f"{folder}/{n}")
        fresh = spark.read.schema(schema).parquet(f"{folder}/{n}")
        if fresh.isEmpty():
            return spark.read.schema(schema).parquet(*(rounds or [f"{folder}/{n}"]))
        rounds.append(f"{folder}/{n}")
        rows = step(fresh).subtract(spark.read.schema(schema).parquet(*rounds))
    raise RecursionError(f"more than {limit} rounds")
