"""Raster operators: masks, stacking, resampling, tiles, histograms, contrast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import ndvi, ndwi
from .zonal import pixels_in


def rasterize(pixels: DataFrame, annotations: DataFrame, group: list[str], key: str = "pixel_id", all_touched: bool = False) -> DataFrame:
    """key, value: 1 for pixels in any annotation, else 0. Pixels without coordinates are 0."""
    inside = pixels_in(pixels.select(key, *group, "x", "y"), annotations, group, all_touched, spread_by=key).select(key).distinct().withColumn("_one", F.lit(1))
    return pixels.select(key).distinct().join(inside, key, "left").select(key, F.coalesce("_one", F.lit(0)).cast("tinyint").alias("value"))


def attach_mask(pixels: DataFrame, mask: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``pixels`` with ``mask_value`` by position, null where the mask has no pixel."""
    return pixels.join(mask.groupBy(*by).agg(F.max(value).alias("mask_value")), by, "left")


def stack_bands(bands: DataFrame, names: Sequence[str], by: list[str], band: str = "band", value: str = "value") -> DataFrame:
    """Long pixels (by, band, value) to one row per pixel with a column per band; absent is null."""
    return bands.groupBy(*by).pivot(band, list(names)).agg(F.first(value, ignorenulls=True))


def unstack_bands(pixels: DataFrame, names: Sequence[str], by: list[str]) -> DataFrame:
    """The reverse: by, band, value, nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in names]))
    return pixels.select(*by, pairs.alias("_p")).select(*by, "_p.band", "_p.value").filter("value is not null")


def to_tiles(pixels: DataFrame, bands: Sequence[str], by: list[str], size: int = 256, col: str = "col_idx", row: str = "row_idx") -> DataFrame:
    """by, tile_col, tile_row, w, h and an array per band, rows first, null where no pixel is.

    A tile holds at most size x size cells. Of repeated pixels the largest value stays.
    """
    at = pixels.withColumns({"tile_col": F.floor(F.col(col) / size).cast("int"), "tile_row": F.floor(F.col(row) / size).cast("int"), "_c": (F.pmod(row, F.lit(size)) * size + F.pmod(col, F.lit(size))).cast("int")})
    one = at.groupBy(*by, "tile_col", "tile_row", "_c").agg(*[F.max(b).cast("double").alias(b) for b in bands])
    maps = one.groupBy(*by, "tile_col", "tile_row").agg(*[F.map_from_entries(F.collect_list(F.struct("_c", b))).alias(b) for b in bands])
    dense = lambda b: F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at(F.col(b), k)).alias(b)
    return maps.select(*by, "tile_col", "tile_row", F.lit(size).alias("w"), F.lit(size).alias("h"), *[dense(b) for b in bands])


def to_pixels(tiles: DataFrame, bands: Sequence[str], by: list[str]) -> DataFrame:
    """The pixel view of tiles: by, col_idx, row_idx and the bands; cells null in all bands left out."""
    cells = F.posexplode(F.arrays_zip(*[F.col(b) for b in bands])).alias("_c", "_v")
    px = tiles.select(*by, "tile_col", "tile_row", "w", "h", cells)
    place = {"col_idx": F.col("tile_col") * F.col("w") + F.col("_c") % F.col("w"), "row_idx": F.col("tile_row") * F.col("h") + F.floor(F.col("_c") / F.col("w")).cast("int")}
    out = px.select(*by, *[c.cast("int").alias(n) for n, c in place.items()], *[F.col(f"_v.{b}").alias(b) for b in bands])
    return out.filter(F.coalesce(*bands).isNotNull())


def resample(pixels: DataFrame, by: list[str], bands: Sequence[str], factor: float, col: str = "col_idx", row: str = "row_idx", nearest: Sequence[str] = ("scl",)) -> DataFrame:
    """Pixels on a grid ``factor`` times as fine (2.0: half the pixel size), bilinear.

    A new pixel's value is the mean of its up to four neighbours, weighted by nearness; absent and
    null ones drop out and the weights are scaled up, so edges stay defined. Bands in ``nearest``
    (class codes) take the nearest neighbour. Every source pixel is sent to the new pixels it
    touches, and one grouped sum does the rest: no pixel ever needs its neighbours in one task.
    """
    f = F.lit(float(factor))
    # centre of new pixel k in source coordinates: (k + 0.5) / factor - 0.5
    reach = lambda c: F.sequence(F.ceil((F.col(c) - 1 + 0.5) * f - 0.5).cast("int"), F.floor((F.col(c) + 1 + 0.5) * f - 0.5).cast("int"))
    sent = pixels.select(*by, F.col(col).alias("_c"), F.col(row).alias("_r"), *bands).dropna(subset=["_c", "_r"])
    sent = sent.filter(F.ceil((F.col("_c") - 0.5) * f - 0.5) <= F.floor((F.col("_c") + 1.5) * f - 0.5)).withColumn("_nc", F.explode(reach("_c")))
    sent = sent.filter(F.ceil((F.col("_r") - 0.5) * f - 0.5) <= F.floor((F.col("_r") + 1.5) * f - 0.5)).withColumn("_nr", F.explode(reach("_r")))
    off = lambda n, c: F.abs((F.col(n) + 0.5) / f - 0.5 - F.col(c))
    sent = sent.filter("_nc >= 0 and _nr >= 0").withColumn("_w", (1 - off("_nc", "_c")) * (1 - off("_nr", "_r"))).filter("_w > 0")
    aggs = []
    for b in bands:
        if b in nearest:
            aggs.append(F.max_by(b, F.when(F.col(b).isNotNull(), F.struct(F.col("_w"), -F.col("_r"), -F.col("_c")))).alias(b))
        else:
            w = F.when(F.col(b).isNotNull(), F.col("_w"))
            aggs.append((F.sum(w * F.col(b)) / F.nullif(F.sum(w), F.lit(0.0))).alias(b))
    return sent.groupBy(*by, F.col("_nc").alias(col), F.col("_nr").alias(row)).agg(*aggs)


def contrast_stretch(pixels: DataFrame, by: list[str], band: str, low: float = 0.04, high: float = 0.92, clip: bool = False) -> DataFrame:
    """``pixels`` with ``stretched``: position between the two percentiles of the group, null if equal."""
    if by:
        joined = pixels.join(pixels.groupBy(*by).agg(F.percentile(band, [low, high]).alias("_p")), by)
    else:  # two numbers
        p = pixels.agg(F.percentile(band, [low, high]).alias("_p")).first()["_p"] or [None, None]
        joined = pixels.withColumn("_p", F.array(*[F.lit(x).cast("double") for x in p]))
    s = F.try_divide(F.col(band) - F.col("_p")[0], F.col("_p")[1] - F.col("_p")[0])
    return joined.withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) if clip else s).drop("_p")


def scaled(pixels: DataFrame, by: list[str], band: str, kind: str = "minmax") -> DataFrame:
    """``pixels`` with ``scaled``: min-max position or z-score (population deviation) in the group.

    Without group columns the two numbers of the whole table are taken.
    """
    aggs = [F.min(band).alias("_a"), (F.max(band) - F.min(band)).alias("_b")] if kind == "minmax" else [F.avg(band).alias("_a"), F.stddev_pop(band).alias("_b")]
    if by:
        both = pixels.join(pixels.groupBy(*by).agg(*aggs), by)
    else:
        a, b = pixels.agg(*aggs).first()
        both = pixels.withColumns({"_a": F.lit(a).cast("double"), "_b": F.lit(b).cast("double")})
    return both.withColumn("scaled", F.try_divide((F.col(band) - F.col("_a")).cast("double"), F.col("_b").cast("double"))).drop("_a", "_b")


def histogram(pixels: DataFrame, by: list[str], band: str, bins: int = 300) -> DataFrame:
    """by, bin (0..bins-1), n over the group's range; the largest value is in the last bin."""
    r = pixels.filter(F.col(band).isNotNull()).groupBy(*by).agg(F.min(band).alias("_lo"), F.max(band).alias("_hi"))
    pos = F.coalesce(F.try_divide((F.col(band) - F.col("_lo")).cast("double") * bins, (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    b = F.least(F.lit(bins - 1), F.floor(pos).cast("int"))
    return pixels.filter(F.col(band).isNotNull()).join(r, by).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pivot_signature(long: DataFrame, band: str, dates: Sequence[str], key: str = "ann_id", date: str = "date") -> DataFrame:
    """One band's signature as rows of ``key`` and a column per date (text)."""
    return long.filter(F.col("band") == band).groupBy(key).pivot(date, list(dates)).agg(F.first("mean", ignorenulls=True))


def chunk_number(key: Column, n: int) -> Column:
    """Chunk 0..n-1 of a row number: rows dealt round by index modulo n."""
    return F.pmod(key, F.lit(n))


def with_fill_value(df: DataFrame, columns: Sequence[str], fill: float = -9999.0) -> DataFrame:
    """Records the no-data value in the columns' metadata; the data stay as they are."""
    return df.select(*[F.col(c).alias(c, metadata={"_FillValue": fill}) if c in columns else F.col(c) for c in df.columns])


def with_indices(pixels: DataFrame, nir: str = "B08", red: str = "B04", swir: str = "B11", only: Sequence[str] = ("NDVI", "NDWI")) -> DataFrame:
    """``pixels`` with the columns of ``only`` that it lacks computed from its bands.

    A column that is there stays as it is, whatever it holds. Bands of other grids must have been
    brought to one grid before (``cube.align``); an index one of whose bands has no column is refused.
    """
    made = {"NDVI": ((nir, red), ndvi), "NDWI": ((nir, swir), ndwi)}
    out = pixels
    for name in only:
        (a, b), index = made[name]
        if name in pixels.columns:
            continue
        if a not in pixels.columns or b not in pixels.columns:
            raise ValueError(f"{name} needs the bands {a} and {b}")
        out = out.withColumn(name, index(F.col(a), F.col(b)))
    return out
