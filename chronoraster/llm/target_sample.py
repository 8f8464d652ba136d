"""Samples whose category shares match targets, by divisor-method priorities.

Within each category the items get random ranks; the item of rank r has priority
(r - 0.5) / target. Taking the smallest priorities of a group seats the categories as the
odd-divisor method does, and the seats of a category that runs out pass to the others without
further steps. Items up to a category's minimum come before all priorities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import bucketed_rank


def label_key(c: Column | str) -> Column:
    """A label without regard to case, spacing and separators; null for null and for nothing left."""
    t = F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+", "")
    return F.when(t != "", t)


def _targets(targets: DataFrame, group: str, label: str) -> DataFrame:
    kept = targets.select(F.col(group).alias("_g"), F.col(label).alias("_label"), label_key(label).alias("_c"), "target_share", "min_keep", "sample_size").filter("_g is not null and _c is not null")
    nonneg = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0))
    share = F.greatest(F.coalesce(F.max(F.when(~F.isnan("target_share"), F.col("target_share"))), F.lit(0.0)), F.lit(0.0))
    return kept.groupBy("_g", "_c").agg(F.min("_label").alias("_label"), share.alias("share"), nonneg("min_keep").alias("floor"), nonneg("sample_size").alias("size"))


def _ranked(items: DataFrame, targets: DataFrame, item: list[str], group: str, label: str, seed: int) -> DataFrame:
    """Distinct items of the wanted categories with their random rank ``_r`` in the category."""
    distinct = items.select(F.col(group).alias("_g"), label_key(label).alias("_c"), *[F.col(c).alias(f"_i{k}") for k, c in enumerate(item)]).dropna().distinct()
    wanted = distinct.join(_targets(targets, group, label), ["_g", "_c"])
    cols = [f"_i{k}" for k in range(len(item))]
    hashed = wanted.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "_g", "_c", *cols)))
    # the first two digits of the hash order as the hash does
    return bucketed_rank(hashed, ["_g", "_c"], F.substring("_h", 1, 2), [F.col("_h"), *map(F.col, cols)], "_r")


def _seated(ranked: DataFrame, cols: list[str]) -> DataFrame:
    """Items that their category's minimum or share admits or that may get a seat of another: with
    ``_floor``, priority ``_p`` and ``_seat``, the place in the group's order of priorities."""
    # an item that is not among the first sample_size of its own category cannot be drawn
    near = ranked.filter(F.col("_r") <= F.greatest("size", "floor"))
    prio = near.withColumns({"_floor": F.col("_r") <= F.col("floor"), "_p": F.try_divide(F.col("_r") - F.lit(0.5), F.col("share"))}).filter("_floor or _p is not null")
    # priorities near the sample size decide; a fixed number of buckets around it keeps the order
    bucket = F.when(F.col("_floor"), -1).otherwise(F.floor(F.least(F.col("_p") / F.col("size"), F.lit(4.0)) * 32))
    order = [F.desc("_floor"), F.asc_nulls_last("_p"), F.col("_c"), F.col("_h"), *map(F.col, cols)]
    return bucketed_rank(prio, ["_g"], bucket, order, "_seat")


def target_sample(items: DataFrame, targets: DataFrame, item: tuple[str, ...] = ("i", "j"), group: str = "cube_name", label: str = "cls", seed: int = 42) -> DataFrame:
    """group, label, item columns: the sample, ``sample_size`` items per group where there are as many.

    Labels are compared without case, spacing and separators; the sample carries the targets'
    spelling. An item listed several times counts once per category. Items with null in group,
    label or item columns, and categories without a target, are not drawn. A category with target
    zero gives its minimum only. If the minimums exceed the sample size, the sample size holds and
    the smallest priorities among the minimums are drawn. Several targets for one category count
    as one with the largest values. Empty inputs give an empty sample.
    """
    cols = [f"_i{k}" for k in range(len(item))]
    drawn = _seated(_ranked(items, targets, list(item), group, label, seed), cols).filter("_seat <= size")
    return drawn.select(F.col("_g").alias(group), F.col("_label").alias(label), *[F.col(a).alias(b) for a, b in zip(cols, item)])


def target_report(items: DataFrame, targets: DataFrame, item: tuple[str, ...] = ("i", "j"), group: str = "cube_name", label: str = "cls", seed: int = 42) -> DataFrame:
    """One row per target: group, label, target_share, min_keep, sample_size, wanted, available, drawn, short.

    ``wanted`` is the greater of the minimum and share x size, ``available`` the category's largest
    rank, ``drawn`` its seats in the sample. A category is short if it got fewer seats than wanted
    because it ran out: all its items within the minimum or of a priority below the sample size,
    which are its own seats before any other category's are passed on, are fewer than wanted.
    """
    t = _targets(targets, group, label)
    ranked = _ranked(items, targets, list(item), group, label, seed)
    there = ranked.groupBy("_g", "_c").agg(F.max("_r").alias("available"))
    # share x size is a whole number in decimal arithmetic; binary noise must not make it short
    own = F.col("_floor") | (F.col("_p") < F.col("size") - 1e-6)
    seats = _seated(ranked, [f"_i{k}" for k in range(len(item))]).groupBy("_g", "_c").agg(F.count(F.when(F.col("_seat") <= F.col("size"), 1)).alias("drawn"), F.count(F.when(own, 1)).alias("_own"))
    out = t.join(there, ["_g", "_c"], "left").join(seats, ["_g", "_c"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("available", "drawn", "_own")})
    wanted = F.greatest(F.col("floor").cast("double"), F.round(F.col("share") * F.col("size"), 6))
    return out.select(
        F.col("_g").alias(group), F.col("_label").alias(label), F.col("share").alias("target_share"), F.col("floor").alias("min_keep"), F.col("size").alias("sample_size"), wanted.alias("wanted"), "available", "drawn",
        ((F.col("drawn") < wanted) & (F.col("_own") < wanted)).alias("short"),
    )
