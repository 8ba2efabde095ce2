"""User-defined functions: scalars and aggregates over Arrow batches, table functions, collations as sort keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """Register f, which maps columns' batches to a batch, for SQL text and as a column function."""
    run = F.pandas_udf(f, returnType=returns)
    spark.udf.register(name, run)
    return run


def aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str) -> Callable[..., Column]:
    """Register f, which maps a group's values to one; it works over windows too. A group's values meet in one task."""

    def run(x: pd.Series) -> object:
        return f(x)

    run.__annotations__ = {"x": pd.Series, "return": _scalar_type(returns)}
    found = F.pandas_udf(run, returnType=returns)
    spark.udf.register(name, found)
    return found


def frame_aggregate(spark: SparkSession, name: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray], returns: str) -> Callable[..., Column]:
    """Register f, which maps many frames' values, flat, and each frame's first place among them to a value a frame.

    The column function takes a column and a short window frame: the frames are gathered by Spark, and f sees a batch of
    them at once. Nulls are left out; a frame of nothing has null. In SQL text the function takes an array.
    """

    def run(frames: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(frames), 0))
        some, out = size > 0, np.zeros(len(size))
        values = np.asarray(frames.flatten())
        if len(values):
            starts = (np.cumsum(size) - size)[some]
            found = np.asarray(f(values, starts))
            out = np.zeros(len(size), found.dtype)
            out[some] = found
        return pa.array(out, mask=~some)

    run.__annotations__ = {"frames": pa.Array, "return": pa.Array}
    found = F.arrow_udf(run, returnType=returns)
    spark.udf.register(name, found)
    return lambda x, frame: found(F.collect_list(x).over(frame))


def _scalar_type(returns: str) -> type:
    return {"string": str, "double": float, "float": float}.get(returns, int)


def table_function(spark: SparkSession, name: str, handler: type, returns: str):
    """Register a class with eval(*args) that yields rows."""
    found = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, found)
    return found


def collation(key: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A collation as the key that texts are compared and sorted by."""
    return key


#: The collations that come along: NOCASE folds A-Z, RTRIM leaves out spaces at the end.
def nocase(x: Column) -> Column:
    from marlpit.functions.strings import ascii_lower

    return ascii_lower(x)


def rtrim(x: Column) -> Column:
    return F.rtrim(x, F.lit(" "))


def uint(x: Column) -> Column:
    return F.struct(F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("decimal(38,0)"), F.lit(-1)), x)
