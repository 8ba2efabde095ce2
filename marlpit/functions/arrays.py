"""Array predicates: containment, overlap, subscripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contained(a: Column, b: Column) -> Column:
    """a @> b: every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0


def overlap(a: Column, b: Column) -> Column:
    """a && b"""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def subscript(a: Column, i: Column | int) -> Column:
    """a[i], from 1; null outside."""
    return F.try_element_at(a, F.lit(i) if isinstance(i, int) else i)
