"""Aggregates that stay NULL where ANSI mode would fail on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows with both values; NULL for a constant side.

    The built-in one divides by zero there, which is an error in ANSI mode.
    """
    a = F.col(x) if isinstance(x, str) else x
    b = F.col(y) if isinstance(y, str) else y
    a2, b2 = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a2) * F.stddev_pop(b2))
