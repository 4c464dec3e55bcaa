"""Truncation of positive numbers to 8 significant bits (the upper half of an IEEE single)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(x: Column) -> Column:
    """x with all but its leading 8 significant bits cleared; not rounded. Zero, null and negative numbers stay as they are."""
    e = F.floor(F.log2(x))
    e = F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    q = F.pow(F.lit(2.0), e - 7)
    return F.when(x > 0, F.floor(x / q) * q).otherwise(x)
