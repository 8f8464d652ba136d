"""Series per source: despiking, smoothing, slope changes, best dates, nearest dates.

Windows have bounded reach, so hot series are split with halo rows (``split_series``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import split_series


def _centred(w, size: int):
    return w.rowsBetween(-(size // 2), (size - 1) // 2)


def despike(df: DataFrame, value: str, key: str = "id", order: str = "obs_time", tie: str | None = None, window: int = 5, z: float = 2.0, hot_rows: int | None = 500_000) -> DataFrame:
    """Adds ``<value>_despiked``: values too far from the centred median become that median.

    Distance is measured in medians of the distances themselves; where that median is 0, any
    distance is too far. Nulls stay null and are passed over by the medians.
    """
    parted = split_series(df, key, order, 2 * window, hot_rows, tie)
    by = [F.col(order), *([F.col(tie)] if tie else [])]
    w = _centred(Window.partitionBy(key, "_part").orderBy(*by), window)
    med = parted.withColumn("_med", F.percentile(value, 0.5).over(w)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = med.withColumn("_mad", F.percentile("_dev", 0.5).over(w))
    far = ((F.col("_mad") == 0) & (F.col("_dev") > 0)) | (0.6745 * F.col("_dev") / F.nullif("_mad", F.lit(0.0)) > z)
    return mad.filter("not _halo").withColumn(f"{value}_despiked", F.when(far, F.col("_med")).otherwise(F.col(value))).drop("_med", "_dev", "_mad", "_part", "_halo")


def smoothed_difference(df: DataFrame, value: str = "ndvi", reference: str = "ndvi_undist", key: str = "id", order: str = "obs_time", tie: str | None = None, window: int = 5, hot_rows: int | None = 500_000) -> DataFrame:
    """Adds ``cdndvi``: centred rolling mean of the reference less that of the value; nulls passed over."""
    parted = split_series(df, key, order, window, hot_rows, tie)
    w = _centred(Window.partitionBy(key, "_part").orderBy(F.col(order), *([F.col(tie)] if tie else [])), window)
    return parted.withColumn("cdndvi", F.avg(reference).over(w) - F.avg(value).over(w)).filter("not _halo").drop("_part", "_halo")


def slope_changes(df: DataFrame, value: str = "cdndvi", key: str = "id", date: str = "date", look_back: int = 4, look_ahead: int = 3, multiplier: float = 2.0, hot_rows: int | None = None) -> DataFrame:
    """key, date: points whose slope to the next exceeds mean + multiplier x deviation of the last
    ``look_back`` slopes (itself among them) and is followed by ``look_ahead`` slopes above that mean.

    Readings of one date are averaged first. With the defaults nothing can fire, since a slope is
    at most 1.5 deviations above the mean of four slopes holding it; use a look-back of 6 or a
    multiplier below 1.5. Slopes at a null are null and end every window they lie in.
    """
    daily = df.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key, date).agg(F.avg(value).alias("_c"))
    # a series has at most a row per day, so by default none is hot
    parted = split_series(daily, key, date, look_back + look_ahead + 2, hot_rows)
    w = Window.partitionBy(key, "_part").orderBy(date)
    slope = (F.lead("_c").over(w) - F.col("_c")) / F.nullif(F.datediff(F.lead(date).over(w), F.col(date)), F.lit(0))
    s = parted.withColumns({"_s": slope, "_i": F.row_number().over(w)})
    back = w.rowsBetween(1 - look_back, 0)
    full = F.count("_s").over(back) == look_back
    t = s.withColumns({"_m": F.when(full, F.avg("_s").over(back)), "_d": F.when(full, F.stddev_samp("_s").over(back))})
    for k in range(1, look_ahead + 1):
        t = t.withColumn(f"_n{k}", F.lead("_s", k).over(w))
    after = reduce(lambda a, b: a & b, [F.col(f"_n{k}") > F.col("_m") for k in range(1, look_ahead + 1)], F.lit(True))
    return t.filter("not _halo").filter((F.col("_i") > look_back) & (F.col("_s") > F.col("_m") + multiplier * F.col("_d")) & after).select(key, date)


def best_date(df: DataFrame, key: str = "ann_id", date: str = "date", confidence: str = "confidence", ordinal: str = "ord", gap_days: int = 40) -> DataFrame:
    """key, best_date: weighted mean date of the heaviest run of dates with gaps up to ``gap_days``.

    Runs are those of density clustering in one dimension with single-point clusters allowed.
    Equal weights: the run with the earliest input row (smallest ``ordinal``). A run without weight
    has no mean, so its date is null. Dates of a key are combined before the window, which the
    calendar bounds. Rows without key or date are passed over; null confidences weigh nothing.
    """
    conf = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))
    daily = df.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key, F.col(date).cast("date").alias("_d")).agg(F.sum(conf).alias("_w"), F.min(ordinal).alias("_o"))
    w = Window.partitionBy(key).orderBy("_d")
    new = F.when(F.datediff("_d", F.lag("_d").over(w)) <= gap_days, 0).otherwise(1)
    runs = daily.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = F.datediff("_d", F.lit("1970-01-01").cast("date"))
    each = runs.groupBy(key, "_run").agg(F.sum("_w").alias("_w"), F.min("_o").alias("_o"), F.sum(days * F.col("_w")).alias("_dw"))
    best = each.groupBy(key).agg(F.min_by(F.struct("_w", "_dw"), F.struct((-F.col("_w")).alias("a"), F.col("_o").alias("b"))).alias("_b"))
    mean = F.floor(F.col("_b._dw") / F.nullif("_b._w", F.lit(0.0))).cast("int")
    return best.select(key, F.date_add(F.lit("1970-01-01").cast("date"), mean).alias("best_date"))


def nearest_date(targets: DataFrame, scenes: DataFrame, group: list[str], target_date: str, scene_date: str, scene_key: str) -> DataFrame:
    """``targets`` with ``nearest_<scene_key>`` and ``nearest_date``; ties go to the earlier date,
    then to the smaller key. Null where the group has no scene or the target no date.

    Dates meet dates, not rows rows: distinct target dates of a group against its distinct scene
    dates, both bounded by the calendar.
    """
    wanted = targets.select(*group, F.col(target_date).alias("_t")).dropna().distinct()
    there = scenes.select(*group, F.col(scene_date).alias("_s"), F.col(scene_key).alias("_k")).dropna().groupBy(*group, "_s").agg(F.min("_k").alias("_k"))
    gap = F.struct(F.abs(F.datediff("_t", "_s")).alias("g"), F.col("_s").alias("d"), F.col("_k").alias("k"))
    near = wanted.join(there, group).groupBy(*group, "_t").agg(F.min(gap).alias("_n"))
    out = targets.withColumn("_t", F.col(target_date)).join(near, [*group, "_t"], "left")
    return out.select(*targets.columns, F.col("_n.k").alias(f"nearest_{scene_key}"), F.col("_n.d").alias("nearest_date"))
