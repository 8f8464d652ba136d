"""The two whole pipelines: pixels to dated changes, and scenes to training patches.

``change_dates`` keeps its gated index pairs, one row per annotation and date, as a table, so the
spatial joins run once however often the series steps read them; ``training_patches`` is one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import patches, timeseries, zonal
from ..session import keep


def change_dates(pixels: DataFrame, annotations: DataFrame, group: list[str], inner: float = 10.0, outer: float = 200.0, look_back: int = 6, multiplier: float = 1.0, pixel_size: float = 10.0) -> DataFrame:
    """ann_id, best_date: per annotation the date its vegetation most likely changed.

    Index in the annotation and in the ring around it (quality-gated) -> despiked series -> smoothed
    difference -> significant slopes -> heaviest run of dates. Annotations without a significant
    slope have no row. ``pixels`` needs pixel_id, x, y, date, scl, ndvi and ``group``.
    """
    inside = zonal.pixels_in(pixels, annotations, group, all_touched=True, pixel_size=pixel_size)
    ring = zonal.pixels_around(pixels, annotations, group, inner, outer, pixel_size)
    pair = keep(zonal.gated_pair(inside, ring, ["ann_id", "date"]).filter("ndvi is not null"), "pairs")
    # a series has at most a row per day, so none is hot
    clean = timeseries.despike(pair, "ndvi", "ann_id", "date", hot_rows=None)
    smooth = timeseries.smoothed_difference(clean, "ndvi_despiked", "ndvi_undist", "ann_id", "date", hot_rows=None)
    dates = timeseries.slope_changes(smooth, "cdndvi", "ann_id", "date", look_back, 3, multiplier)
    return timeseries.best_date(dates.withColumns({"confidence": F.lit(1.0), "ord": F.datediff("date", F.lit("1970-01-01").cast("date"))}))


def training_patches(scenes: DataFrame, pixels: DataFrame, by: list[str], size: int, bands: list[str], ratio: float = 0.3, seed: int = 42, time: str = "date") -> DataFrame:
    """``by``, i, j, cls, time, band, values: sampled patches as dense arrays.

    ``scenes`` holds one row per raster with width and height; ``pixels`` a ``mask`` column.
    """
    grid = patches.patch_classes(patches.patch_grid(scenes, by, size), pixels, by, size)
    chosen = patches.patch_sample(grid, by, ratio, seed, strict=False)
    return patches.patch_arrays(chosen, pixels, by, size, bands, time).join(chosen.select(*by, "i", "j", "cls"), [*by, "i", "j"])
