"""Implausible readings: physical limits, stuck values, spikes, per source.

Each source and field gets a robust exponentially weighted control chart: mean and scale follow
the readings, but a suspected reading is clipped to the chart's limits before it updates them. Run
counters find stuck values, fixed limits find impossible ones. A chart lags where the season turns,
so one runs forward and one backward in time and both must signal. The exact local test (distance
from the centred median of five against the source's own median step) decides what counts as a
spike, and the charts' signal stands beside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing, usable
from ..session import keep
from ..skew import bucketed_rank, exact_median, hot_keys, in_ranges, salted_join
from .batches import whole_groups


@dataclass(frozen=True)
class ChartSpec:
    """Limits of the tests. A cell is impossible if present but outside ``low``..``high``."""

    low: float = -1.0
    high: float = 1.0
    same_reading_s: float = 60.0  # rows of a source closer than this are one reading
    stuck_run: int = 6
    stuck_range: float = 0.0003
    spike_steps: float = 6.0
    weight: float = 0.3  # of the newest reading in the chart
    signal: float = 4.0  # chart limits, in scales
    clip: float = 2.5  # a suspected reading moves the chart at most so many scales
    block: int = 1024  # readings after which a source's charts and run counter start anew, whatever its size
    warm_up: int = 64  # readings before (behind) a block that its charts and counter see first
    hot_rows: int = 500_000  # a source with more rows is cut into parts of whole blocks; results do not change

    def __post_init__(self) -> None:
        if not self.block >= self.warm_up >= self.stuck_run:
            raise ValueError("block, warm-up and stuck run must not increase in this order")


OUT = "field string, row_key bigint, stuck boolean, spike boolean, chart_signal boolean, chart_z double, run_length int"
TINY = 1e-9  # keeps decimal ties from depending on binary rounding


def _chart(group: np.ndarray, v: np.ndarray, spec: ChartSpec, scale0: np.ndarray) -> np.ndarray:
    """Distance from the chart's mean in scales, per reading; ``group`` is 0..n-1, ascending.

    All sources of the batch advance together, one reading per step.
    """
    z = np.zeros(len(v))
    if not len(v):
        return z
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[start, len(v)])
    order = np.argsort(-length, kind="stable")
    start, length, floor = start[order], length[order], scale0[order]
    mean, scale = np.zeros(len(start)), floor.copy()
    # the middle of a source's first five readings starts its chart
    head = np.stack([v[start + np.minimum(k, length - 1)] for k in range(5)])
    mean[:] = np.median(head, axis=0)
    live = len(start)
    for step in range(length[0]):
        while live and length[live - 1] <= step:
            live -= 1
        at = start[:live] + step
        r = v[at] - mean[:live]
        z[at] = r / scale[:live]
        r = np.clip(r, -spec.clip * scale[:live], spec.clip * scale[:live])
        mean[:live] += spec.weight * r
        # 1.25 x the mean absolute deviation estimates a normal standard deviation
        scale[:live] = np.maximum(floor[:live] * 0.5, scale[:live] + spec.weight * 0.5 * (1.25 * np.abs(r) - scale[:live]))
    return z


def _median_by(group: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """Median of ``v`` per group 0..n-1; NaN for groups without a value."""
    order = np.lexsort((v, group))
    g, s = group[order], v[order]
    first, last = np.searchsorted(g, np.arange(n)), np.searchsorted(g, np.arange(n), "right")
    out = np.full(n, np.nan)
    has = last > first
    lo, hi = first[has] + (last - first - 1)[has] // 2, first[has] + (last - first)[has] // 2
    out[has] = (s[lo] + s[hi]) / 2
    return out


def _tests(group: np.ndarray, k: np.ndarray, v: np.ndarray, typical: np.ndarray, spec: ChartSpec) -> dict[str, np.ndarray]:
    """The flags of usable readings, sorted by group (0..n-1) and ``k``, their number in the source.

    ``typical`` holds each group's median step. Blocks are told by ``k``, so a part of a source that
    begins with a block's warm-up gives what the whole source gives.
    """
    m = len(v)
    same = group[1:] == group[:-1]
    # centred median of five
    spike, away = np.zeros(m, bool), np.zeros(m)
    if m >= 5:
        mid = np.arange(2, m - 2)
        inner = group[:-4] == group[4:]
        med = np.median(np.lib.stride_tricks.sliding_window_view(v, 5), axis=1)
        away[mid] = np.where(inner, np.abs(v[mid] - med), 0)
        spike[mid] = inner & (away[mid] > spec.spike_steps * typical[group[mid]] + TINY)
    # runs of nearly equal values: every window of stuck_run readings within the range
    stuck, w = np.zeros(m, bool), spec.stuck_run
    if m >= w:
        win = np.lib.stride_tricks.sliding_window_view(v, w)
        flat = (group[: m - w + 1] == group[w - 1 :]) & (win.max(1) - win.min(1) <= spec.stuck_range + TINY)
        edge = np.zeros(m + 1, int)
        at = np.flatnonzero(flat)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + w, -1)
        stuck = np.cumsum(edge[:-1]) > 0
    # blocks with their warm-up
    block = k // spec.block
    opens = np.flatnonzero(np.r_[True, ~same | (block[1:] != block[:-1])]) if m else np.zeros(0, int)
    first_of = np.searchsorted(group, group[opens])  # the source's first reading
    since = np.maximum(first_of, opens - spec.warm_up)
    ends = np.r_[opens[1:], m][: len(opens)]
    # run-length counter: consecutive readings within the range of the one before
    close = np.r_[False, same & (np.abs(np.diff(v)) <= spec.stuck_range + TINY)][:m]
    begin = np.maximum.accumulate(np.where(close, 0, np.arange(m)))
    run = np.arange(m) - np.maximum(begin, np.repeat(since, ends - opens)) + 1
    # two charts per block, each with its warm-up first: one forward, one backward in time
    floor = np.maximum(np.nan_to_num(typical[group[opens]], nan=0.01), 0.002)
    until = np.minimum(np.searchsorted(group, group[opens], "right"), ends + spec.warm_up)

    def charted(length: np.ndarray, source: np.ndarray) -> np.ndarray:
        block_no = np.repeat(np.arange(len(opens)), length)
        own = (source >= opens[block_no]) & (source < ends[block_no])
        out = np.zeros(m)
        out[source[own]] = _chart(block_no, v[source], spec, floor)[own]
        return out

    count = lambda length: np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    fore = charted(ends - since, np.repeat(since, ends - since) + count(ends - since))
    back = charted(until - opens, np.repeat(until, until - opens) - 1 - count(until - opens))
    # a spike is far from what came before and from what comes after; a turn of the season from one only
    z = np.where(np.abs(back) < np.abs(fore), back, fore)
    return {"stuck": stuck, "spike": spike, "chart_signal": np.abs(z) > spec.signal, "chart_z": z, "run_length": run.astype("int32")}


def _judge(pdf: pd.DataFrame, fields: Sequence[str], spec: ChartSpec) -> pd.DataFrame:
    """Flags of whole sources, rows sorted by source, time and key."""
    sid, t = pdf["id"].to_numpy(), pdf["t"].to_numpy()
    new = np.r_[True, sid[1:] != sid[:-1]]
    group = np.cumsum(new) - 1
    session = np.cumsum(new | np.r_[True, (t[1:] - t[:-1]) >= spec.same_reading_s * 1e6]) - 1
    out = []
    for f in fields:
        v = pdf[f].to_numpy(dtype=float)
        rows = np.flatnonzero(~np.isnan(v))
        if not len(rows):
            continue
        s = session[rows]
        lead = np.r_[True, s[1:] != s[:-1]]
        reading = np.cumsum(lead) - 1  # of each row
        val, g = v[rows[lead]], group[rows[lead]]
        same = g[1:] == g[:-1]
        typical = _median_by(g[1:][same], int(group[-1]) + 1, np.abs(np.diff(val))[same])
        got = _tests(g, np.arange(len(g)) - np.searchsorted(g, g), val, typical, spec)
        hit = (got["stuck"] | got["spike"] | got["chart_signal"])[reading]
        out.append(pd.DataFrame({"field": f, "row_key": pdf["row_key"].to_numpy()[rows[hit]], **{c: x[reading[hit]] for c, x in got.items()}}))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in OUT.split(", ")})


def _hot_flags(rows: DataFrame, n: int, fields: Sequence[str], spec: ChartSpec) -> DataFrame:
    """Flags of sources too large for a task, the same as ``_judge`` gives.

    Readings are numbered without gathering a source: rows lie in ranges of (source, time), and one
    row per range carries on what came before. Parts of whole blocks follow from the numbers, each
    with the readings of the warm-ups before and behind it.
    """
    kind = dict(rows.dtypes)["id"]
    gap = spec.same_reading_s * 1e6
    size = max(1, spec.hot_rows // 2)
    placed = in_ranges(rows, ["id", "t", "row_key"], size, n)
    earlier = Window.partitionBy("id").orderBy("_place")
    ends = placed.groupBy("id", "_place").agg(F.max("t").alias("_last")).select("id", "_place", F.lag("_last").over(earlier).alias("_before"))
    inside = Window.partitionBy("id", "_place").orderBy("t", "row_key")
    begins = F.coalesce((F.col("t") - F.coalesce(F.lag("t").over(inside), "_before") >= gap).cast("int"), F.lit(1))
    local = keep(placed.join(ends, ["id", "_place"]).withColumn("_new", begins).withColumn("_session", F.sum("_new").over(inside)).drop("_before", "_new"), "sessions")
    before = local.groupBy("id", "_place").agg(F.max("_session").alias("_s")).select("id", "_place", F.coalesce(F.sum("_s").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]))
    cells = local.join(before, ["id", "_place"]).select("id", "_place", "t", "row_key", (F.col("_session") + F.col("_offset")).alias("_session"), cells.alias("_c")).filter("_c.v is not null").select("id", "_place", "t", "row_key", "_session", "_c.*")
    # the earliest usable row of a reading gives its value
    readings = cells.groupBy("id", "field", "_session").agg(F.min_by("v", F.struct("t", "row_key")).alias("v"), F.min("_place").alias("_place"))
    readings = keep(bucketed_rank(readings, ["id", "field"], F.col("_place"), [F.col("_session")], "k").select("id", "field", "_session", "v", (F.col("k") - 1).alias("k")), "readings")
    prior = readings.select("id", "field", (F.col("k") + 1).alias("k"), F.col("v").alias("_v"))
    typical = exact_median(readings.join(prior, ["id", "field", "k"]).select("id", "field", F.abs(F.col("v") - F.col("_v")).alias("step")), ["id", "field"], "step")
    length = -(-size // spec.block) * spec.block
    own = F.floor(F.col("k") / length)
    place = lambda p, h: F.struct(p.alias("part"), F.lit(h).alias("halo"))
    ahead = F.when((own + 1) * length - F.col("k") <= spec.warm_up, place(own + 1, True))
    behind = F.when((own > 0) & (F.col("k") - own * length < spec.warm_up), place(own - 1, True))
    parts = readings.withColumn("_p", F.explode(F.filter(F.array(place(own, False), ahead, behind), lambda s: s.isNotNull()))).select("id", "field", "_session", "v", "k", "_p.*")
    parts = parts.join(typical, ["id", "field"], "left")

    def judge(batches):
        for pdf in whole_groups(batches, ("id", "field", "part")):
            key = pdf[["id", "field", "part"]]
            new = np.r_[True, (key.iloc[1:].to_numpy() != key.iloc[:-1].to_numpy()).any(1)]
            got = _tests(np.cumsum(new) - 1, pdf["k"].to_numpy(np.int64), pdf["v"].to_numpy(float), pdf["median"].to_numpy(float)[new], spec)
            hit = (got["stuck"] | got["spike"] | got["chart_signal"]) & ~pdf["halo"].to_numpy()
            yield pd.DataFrame({"id": pdf["id"][hit], "field": pdf["field"][hit], "_session": pdf["_session"][hit], **{c: x[hit] for c, x in got.items()}})

    ordered = parts.repartition("id", "field", "part").sortWithinPartitions("id", "field", "part", "k")
    flagged = ordered.mapInPandas(judge, f"id {kind}, field string, _session bigint, stuck boolean, spike boolean, chart_signal boolean, chart_z double, run_length int")
    return salted_join(cells.select("id", "field", "_session", "row_key"), flagged, ["id", "field", "_session"], F.col("row_key"), spec.hot_rows).select(*[c.split()[0] for c in OUT.split(", ")])


def spike_flags(df: DataFrame, fields: Sequence[str] = ("ndvi", "ndvi_undist"), source: str = "id", time: str = "obs_time", key: str = "rec_id", spec: ChartSpec | None = None) -> DataFrame:
    """Flagged cells: field, row_key, impossible, stuck, spike, chart_signal, chart_z, run_length.

    All rows of a reading (rows of one source less than ``same_reading_s`` apart, chained) share
    its flags where their cell is usable; the earliest usable row gives the reading's value. Cells
    that are missing are never flagged. Impossible cells take no part in the series. Rows without
    source or time are tested against the limits only. Ties in time are ordered by the key.
    Repeated rows give one flag. An empty table gives no rows; other columns are passed over.
    Chart and run counter start anew every ``block`` readings after a warm-up, so a source gives the
    same flags and numbers whether it is small or cut into parts.
    """
    spec = spec or ChartSpec()
    return limit_flags(df, fields, key, spec.low, spec.high).unionByName(_series_flags(df, fields, source, time, key, spec)).distinct()


def limit_flags(df: DataFrame, fields: Sequence[str], key: str, low: float, high: float) -> DataFrame:
    """Cells that are present but outside ``low``..``high``, in the form of ``spike_flags``."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~is_missing(f) & usable(f, low, high).isNull()).alias("bad")) for f in fields]))
    bad = df.select(F.col(key).cast("bigint").alias("row_key"), cells.alias("c")).filter("c.bad")
    no = F.lit(False)
    return bad.select(
        F.col("c.field").alias("field"), "row_key", F.lit(True).alias("impossible"), no.alias("stuck"), no.alias("spike"), no.alias("chart_signal"), F.lit(None).cast("double").alias("chart_z"), F.lit(None).cast("int").alias("run_length")
    )


def _series_flags(df: DataFrame, fields: Sequence[str], source: str, time: str, key: str, spec: ChartSpec) -> DataFrame:
    rows = df.select(
        F.col(source).alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(key).cast("bigint").alias("row_key"), *[usable(f, spec.low, spec.high).cast("double").alias(f) for f in fields]
    ).filter("id is not null and t is not null")
    hot = hot_keys(rows, F.xxhash64("id"), spec.hot_rows)
    cold = rows if hot is None else rows.withColumn("_key", F.xxhash64("id")).join(hot.select("_key"), "_key", "left_anti").drop("_key")

    def judge(batches):
        for pdf in whole_groups(batches, ("id",)):
            yield _judge(pdf, fields, spec)

    flags = cold.repartition("id").sortWithinPartitions("id", "t", "row_key").mapInPandas(judge, OUT)
    if hot is not None:
        large = rows.withColumn("_key", F.xxhash64("id")).join(hot.select("_key"), "_key", "left_semi").drop("_key")
        flags = flags.unionByName(_hot_flags(large, hot.agg(F.sum("_n")).first()[0], fields, spec))
    return flags.select("field", "row_key", F.lit(False).alias("impossible"), "stuck", "spike", "chart_signal", "chart_z", "run_length")
