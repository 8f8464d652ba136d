"""Pixel and scene predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes of bad pixels, of vegetation, and of scenes valid in time.
BAD_CLASSES = (0, 1, 2, 3, 8, 9, 10, 11)
VEGETATION = 4
TIME_VALID = (4, 5, 6)


def is_bad(scl: Column) -> Column:
    return scl.isin(*BAD_CLASSES)


def is_vegetation(scl: Column) -> Column:
    return scl == VEGETATION


def bad_percent(scl: Column) -> Column:
    """Aggregate: percentage of bad pixels among all; null for none."""
    return F.try_divide(100.0 * F.sum(F.when(is_bad(scl), 1).otherwise(0)), F.count(F.lit(1)))


def time_valid(scl: Column, classes: tuple[int, ...] = TIME_VALID) -> Column:
    """Aggregate: more than half of the present pixels are of the valid classes."""
    return F.coalesce(F.count(F.when(scl.isin(*classes), 1)) * 2 > F.count(scl), F.lit(False))


def good_gate(good: Column, n: Column, threshold: float = 70.0) -> Column:
    """At least ``threshold`` percent good; no pixels are 0 percent."""
    return F.coalesce(F.try_divide(100.0 * good, n), F.lit(0.0)) >= threshold


def positive_mean(v: Column) -> Column:
    """Aggregate: mean of values above 0; 0 if there are none."""
    return F.coalesce(F.avg(F.when(v > 0, v.cast("double"))), F.lit(0.0))
