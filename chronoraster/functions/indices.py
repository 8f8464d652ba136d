"""Spectral indices, scaling and raster arithmetic as column expressions. Missing is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndvi(nir: Column, red: Column) -> Column:
    """Reflectances clipped to 0..10000 and scaled; null where their sum is 0; within -1..1."""
    scaled = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(10000.0), c.cast("double"))) / 10000
    # greatest and least skip nulls, so nulls are put back
    n, r = F.when(nir.isNotNull(), scaled(nir)), F.when(red.isNotNull(), scaled(red))
    return _clip((n - r) / F.nullif(n + r, F.lit(0.0)), -1.0, 1.0)


def _clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def ndvi_raw(nir: Column, red: Column) -> Column:
    """Unscaled index; 0 where it is undefined (both bands 0) or a band is missing."""
    n, r = nir.cast("double"), red.cast("double")
    return F.coalesce((n - r) / F.nullif(n + r, F.lit(0.0)), F.lit(0.0))


def ndwi(nir: Column, swir: Column) -> Column:
    """Water index; missing or non-finite inputs count as 0."""
    fix = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), 0.0).otherwise(c.cast("double"))
    n, s = fix(nir), fix(swir)
    return (n - s) / (n + s + 1e-10)


def cross_ratio(vh: Column, vv: Column) -> Column:
    return F.try_divide(vh.cast("double"), vv.cast("double"))


def linear_to_db(x: Column) -> Column:
    """Decibel; null for values that are not positive."""
    return 10 * F.log10(F.when(x.cast("double") > 0, x.cast("double")))


def resolution(transform: Column) -> Column:
    """(x, y) size of a pixel in whole units."""
    return F.struct(transform["a"].cast("int").alias("x_res"), (-transform["e"]).cast("int").alias("y_res"))


def reordered_transform(gdal: Column) -> Column:
    """GDAL's ``c a b f d e`` text as struct a, b, c, d, e, f."""
    p = F.split(F.trim(gdal), r"\s+")
    at = {"a": 1, "b": 2, "c": 0, "d": 4, "e": 5, "f": 3}
    return F.struct(*[F.get(p, F.lit(i)).try_cast("double").alias(k) for k, i in at.items()])


def window_transform(transform: Column, i: Column, j: Column) -> Column:
    """Transform of a window whose upper left pixel is column ``i``, row ``j``."""
    t = transform
    return F.struct(
        t["a"].alias("a"), t["b"].alias("b"), (t["c"] + i * t["a"] + j * t["b"]).alias("c"), t["d"].alias("d"), t["e"].alias("e"), (t["f"] + i * t["d"] + j * t["e"]).alias("f")
    )


def window_extent(transform: Column, i: Column, j: Column, w: Column, h: Column) -> Column:
    """minx, miny, maxx, maxy of a window of a north-up raster."""
    t = window_transform(transform, i, j)
    x0, x1, y0, y1 = t["c"], t["c"] + w * t["a"], t["f"], t["f"] + h * t["e"]
    return F.struct(F.least(x0, x1).alias("minx"), F.least(y0, y1).alias("miny"), F.greatest(x0, x1).alias("maxx"), F.greatest(y0, y1).alias("maxy"))


def rescaled_grid(transform: Column, width: Column, height: Column, resolution: float) -> Column:
    """Grid of the same extent at another pixel size; dimensions are cut to whole pixels."""
    scale = transform["a"] / resolution
    return F.struct(
        scale.alias("scale"), F.lit(float(resolution)).alias("a"), transform["c"].alias("c"), (transform["e"] / scale).alias("e"), transform["f"].alias("f"),
        (width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"),
    )
