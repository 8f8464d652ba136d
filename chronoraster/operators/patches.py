"""Training patches: grid, classes, samples, balance, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import bucketed_rank


def patch_grid(scenes: DataFrame, by: list[str], size: int, overlap: int = 0, width: str = "width", height: str = "height") -> DataFrame:
    """``by``, i, j, w, h: windows sliding by size - overlap over width, then height.

    Patches at the right and lower edge are kept and cut to the raster (w, h). ``scenes`` should
    hold one row per raster.
    """
    step = size - overlap
    if size < 1 or step < 1:
        raise ValueError("the patch size must be positive and exceed the overlap")
    starts = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1, F.lit(step)))
    grid = scenes.select(*by, F.col(width).alias("_w"), F.col(height).alias("_h")).withColumn("i", F.explode(starts("_w"))).withColumn("j", F.explode(starts("_h")))
    return grid.select(*by, "i", "j", F.least(F.lit(size), F.col("_w") - F.col("i")).alias("w"), F.least(F.lit(size), F.col("_h") - F.col("j")).alias("h"))


def _held(pixels: DataFrame, col: str, row: str, size: int, step: int) -> DataFrame:
    """``pixels`` with ``i``, ``j`` of every patch that holds them: one if patches do not overlap."""
    if step == size:
        return pixels.withColumns({"i": F.floor(F.col(col) / size) * size, "j": F.floor(F.col(row) / size) * size})
    spread = lambda c: F.transform(F.sequence(F.lit(0), F.lit((size - 1) // step)), lambda k: (F.floor(F.col(c) / step) - k) * step)
    return pixels.withColumn("i", F.explode(spread(col))).withColumn("j", F.explode(spread(row))).filter((F.col(col) < F.col("i") + size) & (F.col(row) < F.col("j") + size))


def patch_classes(grid: DataFrame, mask: DataFrame, by: list[str], size: int, overlap: int = 0, col: str = "col_idx", row: str = "row_idx", value: str = "mask") -> DataFrame:
    """``grid`` with ``cls``: Annotation where the patch holds a mask pixel other than 0.

    Mask pixels are mapped to the patches that hold them (one without overlap), so pixels meet
    patches in an equi-join on counts that were combined before.
    """
    step = size - overlap
    if size < 1 or step < 1:
        raise ValueError("the patch size must be positive and exceed the overlap")
    set_ = mask.filter((F.col(value) != 0) & F.col(col).isNotNull() & F.col(row).isNotNull()).select(*by, F.col(col).alias("_c"), F.col(row).alias("_r")).distinct()
    hit = _held(set_, "_c", "_r", size, step)
    on = hit.groupBy(*by, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n_set"))
    return grid.join(on, [*by, "i", "j"], "left").withColumn("cls", F.when(F.col("n_set") > 0, "Annotation").otherwise("No-Annotation")).drop("n_set")


def patch_sample(patches: DataFrame, by: list[str], ratio: float = 0.3, seed: int = 42, strict: bool = True) -> DataFrame:
    """All annotated patches and int(n x ratio) others per group, in hashed order.

    ``strict`` raises where a group has too few others; else it takes what there is.
    """
    n = patches.groupBy(*by).agg(F.count(F.when(F.col("cls") == "Annotation", 1)).alias("_a"), F.count(F.when(F.col("cls") != "Annotation", 1)).alias("_o"))
    n = n.withColumn("_want", F.floor(F.col("_a") * F.lit(float(ratio))))
    if strict and not n.filter("_want > _o").isEmpty():
        raise ValueError("not enough patches without annotation for this ratio")
    other = patches.filter("cls <> 'Annotation'").withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(b) for b in by], "i", "j")))
    ranked = bucketed_rank(other, by, F.substring("_h", 1, 2), [F.col("_h"), F.col("i"), F.col("j")], "_rn")
    kept = ranked.join(n.select(*by, "_want"), by).filter("_rn <= _want").select(patches.columns)
    return patches.filter("cls = 'Annotation'").unionByName(kept)


def ratio_sample(patches: DataFrame, by: list[str], classes: tuple[int, int], seed: int = 42) -> DataFrame:
    """All annotated patches and others so that their percentages are ``classes`` (first: annotated)."""
    return patch_sample(patches, by, classes[1] / classes[0], seed)


def patch_balance(patches: DataFrame, by: list[str], count: str = "n_ann", ann_ratio: float = 0.8) -> DataFrame:
    """``patches`` with ``keep``: the scan in order i, j keeps annotated patches, and an empty one
    only while annotated tasks exceed ``ann_ratio`` of all (at the start they do).

    A patch counts once per annotation. The scan is closed-form: with E empty patches seen and
    P annotated tasks, the kept empty ones are min(E, E + running minimum of cap(P) - E), cap being
    how many empty tasks P admits. Columns of a raster bound the scan, not pixels.
    """
    w = Window.partitionBy(*by).orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    empty = F.col(count) == 0
    s = patches.withColumns({"_P": F.sum(F.col(count)).over(w), "_E": F.sum(F.when(empty, 1).otherwise(0)).over(w)})
    p, r = F.col("_P").cast("double"), F.lit(float(ann_ratio))
    if ann_ratio > 0:
        rough = F.ceil(p * (1 - r) / r)
        # an empty patch is accepted while P / (P + N) > r; settle the ceiling against that test
        fits = lambda n: (p + n > 0) & (p / F.nullif(p + n, F.lit(0.0)) > r)
        cap = F.when(fits(rough), rough + 1).when(~fits(rough - 1) & (rough > 0), rough - 1).otherwise(rough)
        cap = F.greatest(F.lit(1 if ann_ratio < 1 else 0), cap)
    else:
        cap = F.when(p > 0, F.lit(1 << 40)).otherwise(F.lit(1))
    t = s.withColumn("_low", F.min(F.when(empty, cap - F.col("_E"))).over(w))
    t = t.withColumn("_N", F.when(F.col("_E") > 0, F.least(F.col("_E"), F.col("_E") + F.col("_low"))).otherwise(0))
    before = F.coalesce(F.lag("_N").over(Window.partitionBy(*by).orderBy("i", "j")), F.lit(0))
    return t.withColumn("keep", ~empty | (F.col("_N") > before)).select(*patches.columns, "keep")


def patch_arrays(grid: DataFrame, pixels: DataFrame, by: list[str], size: int, bands: list[str], time: str = "obs_time", col: str = "col_idx", row: str = "row_idx", overlap: int = 0) -> DataFrame:
    """``by``, i, j, time, band, values: dense rows-first arrays of size x size, 0 where no pixel is.

    Only pixels of the patches in ``grid`` are gathered; a patch has at most size x size cells, so
    its arrays are bounded. Of repeated pixels the largest value counts. Patches without a pixel
    have no rows. ``overlap`` is that of the grid: a pixel is in every patch that holds it.
    """
    step = size - overlap
    if size < 1 or step < 1:
        raise ValueError("the patch size must be positive and exceed the overlap")
    at = _held(pixels.filter(F.col(col).isNotNull() & F.col(row).isNotNull()), col, row, size, step).withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")})
    cell = ((F.col(row) - F.col("j")) * size + F.col(col) - F.col("i")).cast("int")
    one = at.join(grid.select(*by, "i", "j").distinct(), [*by, "i", "j"]).groupBy(*by, "i", "j", time, cell.alias("_c")).agg(*[F.max(b).cast("double").alias(b) for b in bands])
    maps = one.groupBy(*by, "i", "j", time).agg(*[F.map_from_entries(F.collect_list(F.struct("_c", F.coalesce(b, F.lit(0.0))))).alias(b) for b in bands])
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("m")) for b in bands]))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_p.m"), k), F.lit(0.0)))
    return maps.select(*by, "i", "j", time, pairs.alias("_p")).select(*by, "i", "j", time, "_p.band", dense.alias("values"))
