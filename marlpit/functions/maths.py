"""Arithmetic and mathematical functions: null instead of an error or a value that isn't finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null where x is not a number or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def divide(a: Column, b: Column, integers: bool) -> Column:
    """/: truncating between integers, null on zero."""
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0)))) if integers else F.try_divide(a, b)


def remainder(a: Column, b: Column) -> Column:
    """%: sign of the dividend, null on zero."""
    return F.when(b != 0, a % F.nullif(b, F.lit(0)))


def round_away(x: Column, digits: int = 0) -> Column:
    """round(): halves away from zero, on the binary value; always a double."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x.cast("double")) * scale + 0.5) / scale


def ln(x: Column) -> Column:
    """log(x) and ln(x): null unless x is positive."""
    return F.when(x > 0, F.ln(x))


def log_base(b: Column, x: Column) -> Column:
    return F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def power(x: Column, y: Column) -> Column:
    return finite(F.pow(x.cast("double"), y.cast("double")))


def mod(x: Column, y: Column) -> Column:
    return F.when(y != 0, x.cast("double") % F.nullif(y.cast("double"), F.lit(0.0)))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def one_argument(name: str, x: Column) -> Column:
    """sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh exp log10 log2 degrees radians: null unless finite."""
    return finite(F.call_function(name, x.cast("double")))


def sign(x: Column) -> Column:
    return F.signum(x).cast("bigint")


def random() -> Column:
    """A non-negative random bigint."""
    return F.shiftrightunsigned(F.xxhash64(F.uuid()), 1)
