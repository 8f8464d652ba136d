"""Missing and usable cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The no-data codes of the inputs.
NO_DATA = (-9999, 99, 255)


def is_missing(c: Column | str) -> Column:
    """True for null, NaN and the no-data codes; never null."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return d.isNull() | F.isnan(d) | F.coalesce(d.isin(*[float(x) for x in NO_DATA]), F.lit(False))


def usable(c: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    """The value where it is present and within the physical limits, else null."""
    d = F.col(c) if isinstance(c, str) else c
    return F.when(~is_missing(d) & d.cast("double").between(low, high), d)
