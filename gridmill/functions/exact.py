"""Sums that do not depend on the order of rows, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(20,8)"


def exact_sum(c: Column | str) -> Column:
    """Sum as a decimal, then a double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(DECIMAL)).cast("double")


def exact_avg(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return exact_sum(c) / F.count(c)


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part.cast("double") / whole.cast("double")
