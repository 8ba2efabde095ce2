"""Structured Streaming over event tables: windowed counts with late data, and change rows merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlpit.operators import dml


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_to(found: DataFrame, path: str, state: str) -> None:
    """Run a stream over all input that is there, appending what its watermark closes to Parquet files at path."""
    found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window of time; with `late`, a stream's state ends that long after a window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events with no pause of `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str], op: str = "op", order: str = "seq") -> DataFrame:
    """The table after change rows (op: I, U or D); of a key's changes the last by `order` counts."""
    last = changes.groupBy(*(F.col(k).alias(f"__mp_{k}") for k in key)).agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*")
    values = {c: f"s.`{c}`" for c in table.columns}
    return dml.merge(table, last, key, [dml.When(True, "delete", condition=f"s.`{op}` = 'D'"), dml.When(True, "update", values), dml.When(False, "insert", values, f"s.`{op}` <> 'D'")])
