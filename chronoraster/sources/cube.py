"""From raster files to the cube: GeoTIFF rows to pixels with places and dates, bands to one grid.

The rows are those of ``geotiff`` (one per block and band). Their order of steps is that of a cube:
``load_pixels`` for files that hold a scene's stacked bands, ``band_pixels`` and ``align`` for files
with one band each, whose grids may differ; ``window_patch`` reads a window as a dense array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import band_rank
from .geotiff import encode

NO_DATA = -9999.0


def _placed(blocks: DataFrame, keep: Sequence[Column | str], cells: Column) -> DataFrame:
    """Blocks exploded to pixels: ``keep``, col_idx, row_idx, x, y (centres) and the cell's struct ``_v``."""
    px = blocks.select(*keep, "row_off", "col_off", "w", "transform", F.explode(cells).alias("_c"))
    col, row = (F.col("col_off") + F.col("_c.k") % F.col("w")).cast("int"), (F.col("row_off") + F.floor(F.col("_c.k") / F.col("w"))).cast("int")
    t, u, v = F.col("transform"), F.col("col_idx") + 0.5, F.col("row_idx") + 0.5
    px = px.withColumns({"col_idx": col, "row_idx": row})
    return px.withColumns({"x": t["c"] + u * t["a"] + v * t["b"], "y": t["f"] + u * t["d"] + v * t["e"]})


def load_pixels(rows: DataFrame, bands: Sequence[str], by: Sequence[str] = ("path",)) -> DataFrame:
    """``by``, date, row_idx, col_idx, x, y and a column per band of ``bands``, by the files' descriptions.

    A band that a file lacks is null; pixels without a value in any of the bands are left out, as
    are blocks without a transform. Bands of a block meet as arrays, so the shuffle moves blocks and
    not pixels. ``date`` is the day of the file's time tag, null without one. No rows, no pixels.
    """
    key = [*by, "time", "row_off", "col_off", "w", "transform"]
    one = rows.filter("transform is not null").groupBy(*key).agg(*[F.coalesce(F.first(F.when(F.col("description") == b, F.col("values")), True), F.array().cast("array<double>")).alias(b) for b in bands])
    zipped = F.transform(F.arrays_zip(*[F.col(b) for b in bands]), lambda v, k: F.struct(k.alias("k"), v.alias("v")))
    there = F.filter(zipped, lambda c: F.coalesce(*[c["v"][b] for b in bands]).isNotNull())
    return _placed(one, [*by, "time"], there).select(*by, F.to_date("time").alias("date"), "row_idx", "col_idx", "x", "y", *[F.col(f"_c.v.{b}").alias(b) for b in bands])


def band_pixels(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, band, x, y, value, transform, width, height: pixels in long form, nulls left out."""
    there = F.filter(F.transform("values", lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda c: c["v"].isNotNull())
    px = _placed(rows.filter("transform is not null and description is not null"), [*by, "description", "width", "height"], there)
    return px.select(*by, F.col("description").alias("band"), "x", "y", F.col("_c.v").alias("value"), "transform", "width", "height")


def align(pixels: DataFrame, by: Sequence[str], bands: Sequence[str], nearest: Sequence[str] = ("SCL",)) -> DataFrame:
    """``by``, row_idx, col_idx and a column per band, all on the grid of the scene's first band.

    First is the band that ranks first among those present. Bands of the same grid stay as they are;
    others are resampled: bilinear over the up to four source pixels whose centres lie within one
    pixel, weights scaled up where some are missing, or the nearest one for bands in ``nearest``.
    Source pixels are sent to the pixels they touch and one grouped sum does the rest. Pixels
    outside the grid are cut off. North-up grids only; bands not in ``bands`` are left out.
    """
    wanted = pixels.filter(F.col("band").isin(*bands))
    order = F.struct(band_rank(F.col("band")).alias("r"), F.col("band").alias("b"))
    # one row per band of a scene, combined before the shuffle
    grids = wanted.groupBy(*by).agg(F.min_by(F.struct("transform", "width", "height"), order).alias("_g"))
    met = wanted.join(grids, list(by))
    g, t = F.col("_g.transform"), F.col("transform")
    wide, high = F.abs(t["a"] / g["a"]), F.abs(t["e"] / g["e"])  # of a source pixel, in pixels of the grid
    same = (t == g) & (F.col("width") == F.col("_g.width")) & (F.col("height") == F.col("_g.height"))
    u, v = (F.col("x") - g["c"]) / g["a"] - 0.5, (F.col("y") - g["f"]) / g["e"] - 0.5
    met = met.withColumns({"_u": u, "_v": v, "_wide": F.when(same, 0.5).otherwise(F.greatest(wide, F.lit(0.5))), "_high": F.when(same, 0.5).otherwise(F.greatest(high, F.lit(0.5)))})

    def reach(c: str, w: str, n: str) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil(F.col(c) - F.col(w) - 1e-9)), F.least(F.col(n) - 1, F.floor(F.col(c) + F.col(w) + 1e-9))
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))

    sent = met.withColumn("col_idx", F.explode(reach("_u", "_wide", "_g.width"))).withColumn("row_idx", F.explode(reach("_v", "_high", "_g.height")))
    weight = (1 - F.abs(F.col("col_idx") - F.col("_u")) / F.col("_wide")) * (1 - F.abs(F.col("row_idx") - F.col("_v")) / F.col("_high"))
    sent = sent.withColumn("_w", weight).filter("_w > 1e-9")
    aggs = []
    for b in bands:
        own = F.col("band") == b
        if b in nearest:
            aggs.append(F.max_by(F.when(own, F.col("value")), F.when(own, F.struct("_w", -F.col("_v"), -F.col("_u")))).alias(b))
        else:
            w = F.when(own, F.col("_w"))
            aggs.append((F.sum(w * F.col("value")) / F.nullif(F.sum(w), F.lit(0.0))).alias(b))
    return sent.groupBy(*by, "row_idx", "col_idx").agg(*aggs)


def window_patch(rows: DataFrame, by: Sequence[str], col: int, row: int, size: int) -> DataFrame:
    """``by``, band, values: size x size values from (col, row) on, rows first; 0 outside and where null.

    Blocks that do not meet the window are dropped before anything is exploded; with the source's
    option ``window`` they are not even read. A scene without a value in the window has zeros.
    """
    near = rows.filter((F.col("col_off") < col + size) & (F.col("col_off") + F.col("w") > col) & (F.col("row_off") < row + size) & (F.col("row_off") + F.col("h") > row))
    place = F.col("row_off") - row + F.floor(F.col("_c.k") / F.col("w")), F.col("col_off") - col + F.col("_c.k") % F.col("w")
    there = F.filter(F.transform("values", lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda c: c["v"].isNotNull())
    px = near.select(*by, F.col("description").alias("band"), "row_off", "col_off", "w", F.explode(there).alias("_c"))
    px = px.withColumns({"_r": place[0], "_k": place[1]}).filter(f"_r >= 0 and _r < {size} and _k >= 0 and _k < {size}")
    held = px.groupBy(*by, "band").agg(F.map_from_entries(F.collect_list(F.struct((F.col("_r") * size + F.col("_k")).cast("int").alias("i"), F.col("_c.v").alias("v")))).alias("_m"))
    every = rows.select(*by, F.col("description").alias("band")).distinct()
    dense = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_m"), k), F.lit(0.0)))
    return every.join(held, [*by, "band"], "left").select(*by, "band", F.coalesce(dense, F.array_repeat(F.lit(0.0), size * size)).alias("values"))


def encode_tiles(tiles: DataFrame, bands: Sequence[str], path: Column, transform: Column, epsg: Column, time: Column, dtype: str = "int16") -> DataFrame:
    """path, content: every tile of ``raster.to_tiles`` as a GeoTIFF with a description per band.

    ``transform`` is that of the whole raster; the file's own begins at the tile. Nulls become the
    no-data value. The result has the form of Spark's binaryFile source.
    """
    t = transform
    at = F.struct((t["c"] + F.col("tile_col") * F.col("w") * t["a"]).alias("c"), (t["f"] + F.col("tile_row") * F.col("h") * t["e"]).alias("f"), t["a"].alias("a"), t["e"].alias("e"))
    flat = tiles.select(path.alias("path"), at.alias("_t"), epsg.cast("int").alias("_epsg"), time.cast("string").alias("_time"), "w", "h", *bands).select("path", "_t.*", "_epsg", "_time", "w", "h", *bands)

    def write(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                grids = [np.nan_to_num(np.asarray(row[b], float), nan=NO_DATA).reshape(int(row["h"]), int(row["w"])).astype(dtype) for b in bands]
                out.append(encode(grids, (row["a"], 0.0, row["c"], 0.0, row["e"], row["f"]), int(row["_epsg"]), list(bands), row["_time"] or "", NO_DATA))
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    return flat.mapInPandas(write, "path string, content binary")
