"""Change points by binary segmentation with absolute deviation as cost."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import whole_groups


def _costs(v: np.ndarray) -> np.ndarray:
    """Sum of distances from the median of each beginning v[:0], v[:1], ..., with two heaps."""
    low: list[float] = []  # negated
    high: list[float] = []
    below = above = 0.0
    out = np.zeros(len(v) + 1)
    for i, x in enumerate(v.tolist(), 1):
        if low and x < -low[0]:
            heapq.heappush(low, -x)
            below += x
        else:
            heapq.heappush(high, x)
            above += x
        if len(low) > len(high):
            m = -heapq.heappop(low)
            below, above = below - m, above + m
            heapq.heappush(high, m)
        elif len(high) > len(low) + 1:
            m = heapq.heappop(high)
            below, above = below + m, above - m
            heapq.heappush(low, -m)
        # any value between the halves is a median; the upper half's least is one
        out[i] = above - high[0] * len(high) + high[0] * len(low) - below
    return out


def binary_segmentation(v: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """Interior break positions: the split with the largest gain, as long as it exceeds ``penalty``.

    Candidates are multiples of ``jump`` that leave at least ``min_size`` values on either side.
    Costs of all beginnings and ends of a stretch are running sums, so a stretch of n values takes
    n log n steps.
    """
    def split(a: int, b: int):
        ks = np.arange(-(-a // jump) * jump, b, jump)
        ks = ks[(ks - a >= min_size) & (b - ks >= min_size)]
        if not len(ks):
            return None
        fore, back = _costs(v[a:b]), _costs(v[a:b][::-1])
        gain = np.round(fore[-1] - fore[ks - a] - back[b - ks], 9)  # ties must not hang on the order of sums
        best = int(np.argmax(gain))
        return float(gain[best]), int(ks[best]), a, b

    open_, found = [s for s in [split(0, len(v))] if s], []
    while open_:
        gain, k, a, b = max(open_, key=lambda s: (s[0], -s[1]))
        if gain <= penalty:
            break
        open_.remove((gain, k, a, b))
        found.append(k)
        open_ += [s for s in (split(a, k), split(k, b)) if s]
    return sorted(found)


def change_points(df: DataFrame, value: str = "cdndvi", key: str = "id", date: str = "date", penalty: float = 0.5, min_size: int = 2, jump: int = 5) -> DataFrame:
    """key, date: the last date before each change of level.

    Readings of a date are averaged before the series is gathered, so a series has as many values
    as days and no source can fill a task with its rows. Nulls are left out; short series have no
    changes.
    """
    daily = df.filter(F.col(key).isNotNull() & F.col(date).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(date).cast("date").alias("d")).agg(F.avg(value).alias("v"))

    def find(batches):
        for pdf in whole_groups(batches, ["k"]):
            v = pdf["v"].to_numpy(float)
            starts = np.flatnonzero(pdf["k"].ne(pdf["k"].shift()).to_numpy())
            at = [a + k - 1 for a, b in zip(starts, [*starts[1:], len(v)]) for k in binary_segmentation(v[a:b], penalty, min_size, jump)]
            yield pdf.iloc[at][["k", "d"]]

    kind = dict(df.dtypes)[key]
    ordered = daily.repartition("k").sortWithinPartitions("k", "d")
    return ordered.mapInPandas(find, f"k {kind}, d date").select(F.col("k").alias(key), F.col("d").alias(date))
