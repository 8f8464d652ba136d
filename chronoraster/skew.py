"""Hot keys: finding them, salting joins around them, ranking and splitting without one-task groups.

A key is hot when its rows exceed a budget, the number of rows one task should take. Budgets are
absolute: they do not depend on the size of the table, and a key gets as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import keep


def tasks(df: DataFrame) -> int:
    """Partitions for stages whose work is far larger than their bytes, which AQE would merge."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Up to so many hot keys (16 bytes each) are broadcast; more stay a table that joins like any other.
LISTED = 20_000


def key_hash(df: DataFrame, cols: Sequence[str], kinds: dict[str, str] | None = None) -> Column:
    """One number per key, null keys included; ``kinds`` are the types in which the other side has them."""
    kinds = kinds or dict(df.dtypes)
    return F.xxhash64(*[F.col(c).cast(kinds[c]) for c in cols])


def hot_keys(df: DataFrame, key: Column, budget: int, weight: str | None = None) -> DataFrame | None:
    """_key, _n of the keys (hashes) with more than ``budget`` rows; None if there are none.

    ``weight`` names a column that says how many rows a row of ``df`` stands for. Counts combine
    before the shuffle. At most LISTED keys come to the driver, to be broadcast; a longer list is
    kept as a table without a hint, so its joins are chosen, and split where skewed, by AQE.
    """
    spark = df.sparkSession
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(key.alias("_key")).agg(n.cast("bigint").alias("_n")).filter(F.col("_n") > budget)
    rows = counts.limit(LISTED + 1).collect()
    if not rows:
        return None
    if len(rows) > LISTED:
        return keep(counts, "hot")
    table = pa.table({"_key": pa.array([r["_key"] for r in rows], pa.int64()), "_n": pa.array([r["_n"] for r in rows], pa.int64())})
    return F.broadcast(spark.createDataFrame(table))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Column, budget: int = 100_000, how: str = "inner", hot_from: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Inner or left equi-join in which no task gets more than about ``budget`` rows of a key of ``big``.

    A hot key of n rows is spread over ceil(n / budget) salts, and the rows of ``small`` are
    repeated as often for that key only. Without hot keys it is the plain join. Counts are taken of
    ``hot_from``, a table with the same keys that is cheaper to read, if given, where ``weight``
    says how many rows a row stands for. Keys are told hot by their hash; a key that shares a hot
    key's hash is salted on both sides, too.
    """
    kinds = dict(big.dtypes)
    counted = big if hot_from is None else hot_from
    hot = hot_keys(counted, key_hash(counted, on, kinds), budget, weight)
    if hot is None:
        return big.join(small, list(on), how)
    salts = hot.select("_key", F.ceil(F.col("_n") / budget).cast("int").alias("_salts"))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread_by), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    left = big.withColumn("_key", key_hash(big, on)).join(salts, "_key", "left").withColumn("_salt", salt).drop("_key", "_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    right = small.withColumn("_key", key_hash(small, on, kinds)).join(salts, "_key", "left").withColumn("_salt", each).drop("_key", "_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def bucketed_rank(df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``, the row number within ``part`` in the order given, without a one-task group.

    ``bucket`` must not decrease along the order. Each (part, bucket) is ranked by itself; the
    offset of a bucket is the running sum of the counts of the earlier ones, so the window over
    ``part`` alone sees one row per bucket and never the rows themselves.
    """
    b = df.withColumn("_rank_bucket", bucket)
    counts = b.groupBy(*part, "_rank_bucket").agg(F.count(F.lit(1)).alias("_rank_n"))
    before = Window.partitionBy(*part).orderBy("_rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_rank_bucket", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_before"))
    ranked = b.withColumn("_rank_in", F.row_number().over(Window.partitionBy(*part, "_rank_bucket").orderBy(*order)))
    return ranked.join(offsets, [*part, "_rank_bucket"]).withColumn(name, F.col("_rank_before") + F.col("_rank_in")).drop("_rank_bucket", "_rank_before", "_rank_in")


def in_ranges(df: DataFrame, order: Sequence[str], size: int, n: int) -> DataFrame:
    """A kept copy of the ``n`` rows of ``df`` with ``_place``: ranges of ``order`` of about ``size`` rows.

    The ranges come from samples, so the copy is written: a later read must not draw them again.
    """
    parts = max(1, -(-n // size))
    return keep(df.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("_place", F.spark_partition_id()), "ranges")


def split_series(df: DataFrame, key: str, order: str, halo: int, hot_rows: int | None = 500_000, tie: str | None = None) -> DataFrame:
    """Adds ``_part`` and ``_halo`` so that windows of bounded reach need not see a whole hot series.

    Series with more than ``hot_rows`` rows are cut into parts of half as many rows, in the order of
    ``order`` and ``tie``, and each part also gets its neighbours' nearest ``halo`` rows, marked
    ``_halo``; a window over (key, _part) then sees what it would see over the key. Others are one
    part. Rows are numbered without gathering a series (``bucketed_rank`` over ranges), so there may
    be any number of parts. None for ``hot_rows`` says that a series is bounded anyhow.
    """
    plain = df.withColumns({"_part": F.lit(0).cast("bigint"), "_halo": F.lit(False)})
    if hot_rows is None:
        return plain
    hot_rows = max(hot_rows, 8 * halo)  # a part holds half of that, so halos come from the next part only
    hot = hot_keys(df, F.xxhash64(key), hot_rows)
    if hot is None:
        return plain
    size = hot_rows // 2
    by = ["_key", key, order, *([tie] if tie else [])]
    marked = df.withColumn("_key", F.xxhash64(key))
    placed = in_ranges(marked.join(hot, "_key"), by, size, hot.agg(F.sum("_n")).first()[0])
    ranked = bucketed_rank(placed, ["_key"], F.col("_place"), [F.col(c) for c in by], "_rn").withColumn("_rn", F.col("_rn") - 1)
    last = F.floor(F.col("_n") / size) - 1
    part = F.least(F.floor(F.col("_rn") / size), last)
    end = F.when(F.col("_p") < last, (F.col("_p") + 1) * size)
    place = lambda p, h: F.struct(p.cast("bigint").alias("p"), F.lit(h).alias("h"))
    own, fore, back = place(F.col("_p"), False), place(F.col("_p") - 1, True), place(F.col("_p") + 1, True)
    places = F.array(own, F.when((F.col("_p") > 0) & (F.col("_rn") - F.col("_p") * size < halo), fore), F.when(end - F.col("_rn") <= halo, back))
    cut = ranked.withColumn("_p", part).withColumn("_at", F.explode(F.filter(places, lambda s: s.isNotNull())))
    cut = cut.withColumns({"_part": F.col("_at.p"), "_halo": F.col("_at.h")})
    return marked.join(hot.select("_key"), "_key", "left_anti").drop("_key").withColumns({"_part": F.lit(0).cast("bigint"), "_halo": F.lit(False)}).unionByName(cut.select(plain.columns))


def exact_median(df: DataFrame, by: Sequence[str], value: str, bins: int = 4096) -> DataFrame:
    """``by``, median of ``value`` (not null), without gathering a group.

    Counts in ``bins`` bins find those that hold the middle ranks; distinct values are counted in
    these bins only. Windows see one row per bin, or per distinct value of a bin.
    """
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_all"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins))
    binned = df.join(span, list(by)).withColumn("_bin", place)
    middle = lambda before, n: reduce(lambda a, b: a | b, [(before <= r) & (r < before + n) for r in (F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))])
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bins_ = binned.groupBy(*by, "_all", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    bins_ = bins_.withColumn("_before", F.coalesce(F.sum("_n").over(upto(by, "_bin")), F.lit(0))).filter(middle(F.col("_before"), F.col("_n")))
    each = binned.join(bins_.select(*by, "_bin", "_before"), [*by, "_bin"]).groupBy(*by, "_all", "_bin", "_before", value).agg(F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(upto([*by, "_bin"], value)), F.lit(0))).filter(middle(F.col("_before"), F.col("_n")))
    return each.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
