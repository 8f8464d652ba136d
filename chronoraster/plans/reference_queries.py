"""Queries of the satellite time-series operators over the driver's tables, and their SQL.

Bands, classes and masks come as in the tables: no-data becomes null when read (``pixels``). Radar
pixels are read from lineitem (VV: price, VH: quantity), candidate dates from orders, as no table
holds them. Floating sums are rounded, since engines add in different orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import indices as I
from ..functions import names as N
from ..functions.missing import is_missing, usable
from ..functions.predicates import time_valid
from ..operators import changepoint, patches, raster, scenes, timeseries, zonal
from ..operators.proximity import crs_code
from ..session import keep
from ..skew import bucketed_rank
from ..sources import cube, geotiff
from . import pipelines
from .reference_sql import SQL  # noqa: F401

CUBE = ["cube_name"]
SIZE = 64


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark, d) -> DataFrame:
    """xds_pixels with no-data as null; 99 and 255 are legal reflectances."""
    band = lambda c: F.when(~F.isnan(c) & (F.col(c) != -9999), F.col(c)).alias(c)
    return _t(spark, d, "xds_pixels").select(
        "pixel_id", "cube_name", "scene_id", F.col("obs_time").cast("date").alias("date"), "row_idx", "col_idx", "x", "y", "tile_i", "tile_j", "id",
        band("b02"), band("b04"), band("b08"), usable("scl", 0, 11).cast("int").alias("scl"), F.when(~is_missing("mask"), F.col("mask").cast("int")).alias("mask"),
    ).withColumn("ndvi", I.ndvi(F.col("b08"), F.col("b04")))


def catalogue(spark, d) -> DataFrame:
    return scenes.distinct_scenes(_t(spark, d, "scenes"))


def series(spark, d) -> DataFrame:
    return _t(spark, d, "ndvi_series").select("rec_id", "id", "obs_time", usable("ndvi").alias("ndvi"), usable("ndvi_undist").alias("ndvi_undist")).filter("id is not null and obs_time is not null")


def annotations(spark, d) -> DataFrame:
    return _t(spark, d, "annotations").select("id", "cube_name", "rings", "pre_date", "post_date", "crs")


def radar(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("pixel")).agg(
        (F.max("l_extendedprice") / 1e5).alias("vv"), (F.max("l_quantity") / 100).alias("vh")
    )


def r(c, n: int = 6):
    return F.round(c, n)


# --- scenes ---------------------------------------------------------------------------------------


def scene_catalogue(spark, d):
    return catalogue(spark, d).select("scene_id", "satellite", "orbit", "cube_name", "scene_date", F.size("band_paths").alias("n_bands"))


def band_parse(spark, d):
    b = scenes.bands_of(catalogue(spark, d)).withColumn("stem", N.stem(F.col("path")))
    s2 = F.col("scene_id").startswith("s2")
    return b.select(
        "scene_id", "band", N.s2_band(F.col("path")).alias("s2_band"), N.s1_band(F.col("path")).alias("s1_band"), "rank", N.band_digits_rank(F.col("band")).alias("digits_rank"),
        F.when(s2, N.s2_scene_date(N.s2_scene_name(F.col("stem")))).otherwise(N.s1_scene_date(F.col("stem"))).alias("file_date"),
        F.when(s2, N.s2_scene_name(F.col("stem"))).otherwise(N.s1_scene_name(F.col("stem"))).alias("file_scene"), N.orbit(F.col("stem")).alias("file_orbit"),
    )


def cube_date_range(spark, d):
    return scenes.date_range(catalogue(spark, d), ["cube_name", "satellite"])


def incomplete_scenes(spark, d):
    lacking = scenes.incomplete_scenes(catalogue(spark, d).filter("satellite = 'sentinel-2'"), ["B02", "B04", "B08", "SCL"])
    return lacking.select("scene_id", F.array_join(F.sort_array("missing"), ",").alias("missing"))


def band_parse_old(spark, d):
    """The older spellings: index layers among the bands, radar bands in lower case, times in names."""
    b = scenes.bands_of(catalogue(spark, d)).withColumn("stem", N.stem(F.col("path")))
    return b.select("scene_id", "band", N.s2_band(F.col("path"), True).alias("s2_band"), N.s1_band(F.col("path"), False).alias("s1_band"), N.s1_old_time(F.col("stem")).alias("old_time"))


def band_lookup(spark, d):
    """Per scene the path of one band, and the first band whose pixels are as wide as asked for."""
    c = catalogue(spark, d)
    sized = scenes.bands_of(c).join(c.select("scene_id", I.resolution(F.col("geotransform"))["x_res"].alias("x_res")), "scene_id")
    return c.select("scene_id", scenes.band_path("B04").alias("b04_path")).join(scenes.band_by_resolution(sized, 10), "scene_id", "left")


def scene_resolution(spark, d):
    c = catalogue(spark, d)
    g = I.rescaled_grid(F.col("geotransform"), F.col("width"), F.col("height"), 20.0)
    return c.select("scene_id", I.resolution(F.col("geotransform")).alias("_r"), g.alias("_g")).select("scene_id", "_r.x_res", "_r.y_res", F.col("_g.width").alias("width_20m"), F.col("_g.height").alias("height_20m"))


def scene_removed(spark, d):
    return scenes.remove_scene(catalogue(spark, d).filter("satellite = 'sentinel-2'"), 0, CUBE).select("cube_name", "scene_id")


def sensors_united(spark, d):
    c = catalogue(spark, d)
    both = scenes.add_scenes(c.filter("satellite = 'sentinel-1'").drop("height"), c.filter("satellite = 'sentinel-2'").drop("orbit"))
    return both.groupBy("cube_name").agg(F.count("orbit").alias("n_orbit"), F.count("height").alias("n_height"), F.count(F.lit(1)).alias("n"))


def bad_pixel_ratio(spark, d):
    return zonal.bad_ratio(pixels(spark, d), ["scene_id"])


def time_mask(spark, d):
    return pixels(spark, d).groupBy("scene_id").agg(time_valid(F.col("scl")).alias("valid"))


def closest_image(spark, d):
    s2 = catalogue(spark, d).filter("satellite = 'sentinel-2'").select("cube_name", "scene_id", "scene_date")
    return timeseries.nearest_date(annotations(spark, d).select("id", "cube_name", "pre_date"), s2, CUBE, "pre_date", "scene_date", "scene_id")


def monthly_timeseries(spark, d):
    s2 = catalogue(spark, d).filter("satellite = 'sentinel-2'")
    return scenes.scenes_per_month(s2, bad_pixel_ratio(spark, d), 70, CUBE).groupBy("cube_name", "scene_id", "scene_date", "padding").agg(F.count(F.lit(1)).alias("copies"))


def timeseries_pad(spark, d):
    s2 = catalogue(spark, d).filter("satellite = 'sentinel-2' and scene_date is not null")
    return scenes.pad_scenes(s2.select("cube_name", "scene_id", "scene_date"), s2, 70, CUBE).groupBy("cube_name", "scene_id", "padding").agg(F.count(F.lit(1)).alias("copies"))


def event_timeseries(spark, d):
    s2 = catalogue(spark, d).filter("satellite = 'sentinel-2'")
    return scenes.scenes_around_event(annotations(spark, d), s2, 6, CUBE).select("id", "role", "scene_id")


def event_timeseries_padded(spark, d):
    """More scenes than a cube has: what lacks is padding."""
    s2 = catalogue(spark, d).filter("satellite = 'sentinel-2'")
    return scenes.scenes_around_event(annotations(spark, d), s2, 150, CUBE).groupBy("id", "role", "scene_id").agg(F.count(F.lit(1)).alias("copies"))


# --- pixels ---------------------------------------------------------------------------------------


def ndvi_current(spark, d):
    return pixels(spark, d).select("pixel_id", "ndvi")


def ndvi_old(spark, d):
    return pixels(spark, d).select("pixel_id", I.ndvi_raw(F.col("b08"), F.col("b04")).alias("ndvi"))


def ndwi(spark, d):
    return pixels(spark, d).select("pixel_id", I.ndwi(F.col("b08"), F.col("b02")).alias("ndwi"))


def cross_ratio(spark, d):
    return radar(spark, d).select("scene", "pixel", I.cross_ratio(F.col("vh"), F.col("vv")).alias("cr"))


def linear_to_db(spark, d):
    return radar(spark, d).select("scene", "pixel", r(I.linear_to_db(F.col("vh"))).alias("db"))


def mean_sar(spark, d):
    m = zonal.mean_radar(radar(spark, d), ["scene"])
    return m.select("scene", r("vv", 9).alias("vv"), r("vh", 9).alias("vh"))


def minmax(spark, d):
    return raster.scaled(pixels(spark, d), ["scene_id"], "b04").select("pixel_id", "scaled")


def zscore(spark, d):
    return raster.scaled(pixels(spark, d), ["scene_id"], "b04", "zscore").select("pixel_id", r("scaled").alias("scaled"))


def minmax_global(spark, d):
    return raster.scaled(pixels(spark, d), [], "b04").select("pixel_id", "scaled")


def indices_added(spark, d):
    """Indices that the pixels lack; B02 stands for the absent short-wave band."""
    p = pixels(spark, d).withColumnRenamed("ndvi", "NDVI")
    return raster.with_indices(p, "b08", "b04", "b02").select("pixel_id", "NDVI", "NDWI")


def contrast_stretch(spark, d):
    return raster.contrast_stretch(pixels(spark, d), CUBE, "b04", 0.04, 0.92).select("pixel_id", r("stretched").alias("stretched"))


def histogram_300(spark, d):
    return raster.histogram(pixels(spark, d), CUBE, "b04")


def stacked_bands(spark, d):
    p = pixels(spark, d).filter("scene_id is not null")
    key = ["scene_id", "row_idx", "col_idx"]
    one = p.groupBy(*key).agg(F.max("b02").alias("b02"), F.max("b04").alias("b04"))
    return raster.stack_bands(raster.unstack_bands(one, ["b02", "b04"], key), ["b02", "b04"], key)


def tile_round_trip(spark, d):
    p = pixels(spark, d).filter("scene_id is not null")
    return raster.to_pixels(raster.to_tiles(p, ["b04", "b08"], ["scene_id"], 32), ["b04", "b08"], ["scene_id"])


def resample_bilinear(spark, d):
    p = pixels(spark, d).filter("scene_id is not null").groupBy("scene_id", "row_idx", "col_idx").agg(F.max("b04").alias("b04"), F.max("scl").alias("scl"))
    return raster.resample(p, ["scene_id"], ["b04", "scl"], 2.0).select("scene_id", "col_idx", "row_idx", r("b04").alias("b04"), "scl")


# --- files ----------------------------------------------------------------------------------------


def _files(spark, d, bands: list[str], size: int = 32, grid: str = "geotransform") -> DataFrame:
    """path, content: the pixels of every scene as GeoTIFF files, one per scene and ``size`` x ``size`` window."""
    c = catalogue(spark, d).select("scene_id", F.col(grid).alias("t"), F.lpad(crs_code("crs"), 5, "0").alias("epsg"), F.col("scene_date").cast("string").alias("day"))
    tiles = raster.to_tiles(pixels(spark, d).filter("scene_id is not null"), bands, ["scene_id"], size).join(c.filter("t is not null"), "scene_id")
    path = F.concat_ws("/", "scene_id", F.concat_ws("_", "tile_col", "tile_row"))
    return cube.encode_tiles(tiles, bands, path, F.col("t"), F.coalesce(F.col("epsg").try_cast("int"), F.lit(0)), F.col("day"))


def _rows(files: DataFrame, **kw) -> DataFrame:
    return geotiff.decode_files(files, **kw).withColumn("scene_id", F.split("path", "/")[0])


def geotiff_pixels(spark, d):
    """Pixels written as raster files and read back with places and dates."""
    px = cube.load_pixels(_rows(_files(spark, d, ["b04", "b08"])), ["b04", "b08"], ["scene_id", "path"])
    return px.select("scene_id", "date", "x", "y", "b04", "b08")


def stack_aligned(spark, d):
    """Files of a fine band and of a coarse one, brought to the grid of the fine one."""
    p = pixels(spark, d).filter("scene_id is not null")
    c = catalogue(spark, d).filter("geotransform is not null")
    fine = p.groupBy("scene_id", "col_idx", "row_idx").agg(F.max("b04").alias("value")).withColumn("band", F.lit("B04"))
    coarse = p.groupBy("scene_id", F.floor(F.col("col_idx") / 2).cast("int").alias("col_idx"), F.floor(F.col("row_idx") / 2).cast("int").alias("row_idx")).agg(F.max("b08").alias("value")).withColumn("band", F.lit("B11"))
    t = F.col("geotransform")
    scale = F.when(F.col("band") == "B11", 2.0).otherwise(1.0)
    own = F.struct((t["a"] * scale).alias("a"), t["b"].alias("b"), t["c"].alias("c"), t["d"].alias("d"), (t["e"] * scale).alias("e"), t["f"].alias("f"))
    long = fine.unionByName(coarse).join(c.select("scene_id", "geotransform", "width", "height"), "scene_id").filter("value is not null").withColumn("transform", own)
    at = {"x": F.col("transform.c") + (F.col("col_idx") + 0.5) * F.col("transform.a"), "y": F.col("transform.f") + (F.col("row_idx") + 0.5) * F.col("transform.e")}
    size = {n: F.when(F.col("band") == "B11", F.ceil(F.col(n) / 2)).otherwise(F.col(n)).cast("int") for n in ("width", "height")}
    z = cube.align(long.withColumns({**at, **size}), ["scene_id"], ["B04", "B11"])
    return z.select("scene_id", "row_idx", "col_idx", "B04", r("B11").alias("B11"))


def patch_window(spark, d):
    """One window of every file, read alone; zeros where it holds nothing."""
    files = _files(spark, d, ["b04"])
    w = cube.window_patch(_rows(files, window=(4, 4, 16, 16)), ["scene_id", "path"], 4, 4, 16)
    return w.select("path", "band", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total")).filter("total <> 0")


# --- polygons -------------------------------------------------------------------------------------


def annotation_boxes(spark, d):
    b = G.bounding_box(F.col("rings"), 5.0)
    return annotations(spark, d).select("id", b.alias("_b"), crs_code("crs").alias("crs_code"), F.coalesce(F.size(G.repair(F.col("rings"))), F.lit(0)).alias("n_rings")).select("id", "_b.*", "crs_code", "n_rings")


def pixel_in_annotation(spark, d):
    return zonal.pixels_in(pixels(spark, d), annotations(spark, d), CUBE).select("pixel_id", "ann_id").distinct()


def pixel_touches_annotation(spark, d):
    return zonal.pixels_in(pixels(spark, d), annotations(spark, d), CUBE, all_touched=True).select("pixel_id", "ann_id").distinct()


def rasterize_mask(spark, d):
    return raster.rasterize(pixels(spark, d), annotations(spark, d), CUBE)


def mask_attached(spark, d):
    p, by = pixels(spark, d), ["cube_name", "row_idx", "col_idx"]
    m = p.filter("mask is not null").groupBy(*by).agg(F.max("mask").alias("value"))
    return raster.attach_mask(p, m, by).select("pixel_id", "mask_value")


def _inside(spark, d):
    return zonal.pixels_in(pixels(spark, d), annotations(spark, d), CUBE)


def zonal_ndvi_gated(spark, d):
    z = zonal.gated_ndvi(_inside(spark, d), ["ann_id", "scene_id"])
    return z.select("ann_id", "scene_id", r("mean").alias("mean"), r("median").alias("median"), "n")


def ring_ndvi(spark, d):
    p, a = pixels(spark, d), annotations(spark, d)
    ring = zonal.pixels_around(p, a, CUBE, 10.0, 200.0, 10.0)
    z = zonal.gated_pair(zonal.pixels_in(p, a, CUBE, all_touched=True), ring, ["ann_id", "date"])
    return z.select("ann_id", "date", r("ndvi").alias("ndvi"), r("ndvi_undist").alias("ndvi_undist"))


def _rungs(spark, d) -> int:
    """Rungs of the ladder 100 x 1.5^k up to the largest raster's diagonal, eight at least."""
    side = lambda n, a: F.col(n) * F.abs(F.col(f"geotransform.{a}"))
    diagonal = F.hypot(side("width", "a"), side("height", "e"))
    # only scenes listed with several sizes need the choice between their rows
    each = _t(spark, d, "scenes").filter("scene_id is not null").groupBy("scene_id").agg(F.min(diagonal).alias("lo"), F.max(diagonal).alias("hi"), (F.count(diagonal) % F.count(F.lit(1))).alias("some"))
    clear = (F.coalesce("lo", F.lit(0.0)) == F.coalesce("hi", F.lit(0.0))) & (F.col("some") == 0)
    reach, unclear = each.agg(F.max(F.when(clear, F.col("hi"))), F.count_if(~clear)).first()
    if unclear:
        listed = scenes.distinct_scenes(_t(spark, d, "scenes").join(each.filter(~clear).select("scene_id"), "scene_id", "left_semi"))
        reach = max(reach or 0.0, listed.agg(F.max(diagonal)).first()[0] or 0.0)
    return max(8, 1 + math.ceil(math.log(max(reach or 0.0, 100.0) / 100.0, 1.5)))


def _own(spark, d):
    return keep(zonal.gated_ndvi(_inside(spark, d), ["ann_id", "date"]), "own")


def _vegetation_near(spark, d, own, rungs):
    """Vegetation that decides the ladder, on the days on which annotations have pixels of their own."""
    return zonal.in_growing_reach(pixels(spark, d), annotations(spark, d), own, ["cube_name", "date"], ["ann_id", "date"], rungs=rungs)


def buffer_ladder_ndvi(spark, d):
    own = _own(spark, d)
    rungs = _rungs(spark, d)
    z = zonal.growing_buffer_ndvi(_vegetation_near(spark, d, own, rungs), own, ["ann_id", "date"], rungs=rungs)
    return z.select("ann_id", "date", "radius", r("mean").alias("mean"), r("median").alias("median"))


def dating_map(spark, d):
    own = _own(spark, d)
    rungs = _rungs(spark, d)
    around = zonal.growing_buffer_ndvi(_vegetation_near(spark, d, own, rungs), own, ["ann_id", "date"], rungs=rungs)
    z = zonal.dating_stats(own, around, ["ann_id", "date"])
    return z.select("ann_id", "date", *[r(c).alias(c) for c in ("ann_mean", "ann_median", "buf_mean", "buf_median")])


def spectral_signature(spark, d):
    z = zonal.signature(_inside(spark, d), ["ann_id", "date"], ["b02", "b04", "b08"])
    return z.select("ann_id", "date", "band", r("mean").alias("mean"))


def band_means(spark, d):
    """Plain means, of all values and not of the positive ones only."""
    z = zonal.signature(_inside(spark, d), ["ann_id"], ["b02", "b04", "b08"], positive=False)
    return z.select("ann_id", "band", r("mean").alias("mean"))


def signature_pivot(spark, d):
    long = zonal.signature(_inside(spark, d), ["ann_id", "date"], ["b04"]).withColumn("date", F.date_format("date", "yyyyMMdd"))
    dates = [x.d for x in pixels(spark, d).select(F.date_format("date", "yyyyMMdd").alias("d")).filter("d is not null").distinct().orderBy("d").collect()]
    return raster.pivot_signature(long.withColumn("mean", r("mean")), "b04", dates)


def signature_json(spark, d):
    return zonal.signature_json(spectral_signature(spark, d))


def scl_histogram(spark, d):
    return zonal.class_counts(_inside(spark, d), ["ann_id"])


def scl_map(spark, d):
    return zonal.class_map(scl_histogram(spark, d), ["ann_id"])


def ann_bad_pixel_filter(spark, d):
    return zonal.reliable(scl_histogram(spark, d), ["ann_id"])


def class_ring(spark, d):
    near = zonal.pixels_around(pixels(spark, d), annotations(spark, d), CUBE, 0.0, 100.0)
    return zonal.class_ring(near, ["ann_id"], [4])


def nearby_ndvi(spark, d):
    near = zonal.pixels_around(pixels(spark, d), annotations(spark, d), CUBE, 0.0, 100.0)
    z = zonal.nearby_mean(near, zonal.class_ring(near, ["ann_id"], [4]), ["ann_id"], annotations(spark, d).select(F.col("id").alias("ann_id")))
    return z.select("ann_id", r("mean").alias("mean"))


def extent_pixels(spark, d):
    boxes = _t(spark, d, "annotations").select("id", "cube_name", "minx", "miny", "maxx", "maxy")
    return zonal.rectangle_mask(pixels(spark, d), boxes, CUBE).select("pixel_id", "ann_id").distinct()


def annotations_reprojected(spark, d):
    a = annotations(spark, d).withColumn("_code", crs_code("crs"))
    supported = ["4326", *[f"{h}{z:02d}" for h in (326, 327) for z in range(1, 61)]]  # at most 121 branches
    codes = [x["_code"] for x in a.select("_code").filter(F.col("_code").isin(*supported)).distinct().orderBy("_code").collect()]
    there = F.lit(None)
    for code in codes:
        there = F.when(F.col("_code") == code, G.reproject(F.col("rings"), code, "4326")).otherwise(there)
    c = a.filter(F.col("_code").isin(*codes)).select("id", there.alias("rings")).select("id", G.bounding_box(F.col("rings")).alias("_b"))
    return c.select("id", r("_b.minx").alias("lon"), r("_b.miny").alias("lat")).filter("lon is not null")


# --- series ---------------------------------------------------------------------------------------


def despike(spark, d):
    return timeseries.despike(series(spark, d), "ndvi", tie="rec_id").select("rec_id", "ndvi_despiked")


def cdndvi(spark, d):
    return timeseries.smoothed_difference(series(spark, d), tie="rec_id").select("rec_id", r("cdndvi").alias("cdndvi"))


def slope_changes(spark, d):
    s = series(spark, d).filter("ndvi is not null").withColumn("date", F.col("obs_time").cast("date"))
    return timeseries.slope_changes(s, "ndvi", look_back=6, multiplier=1.0)


def best_date(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("ann_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").alias("confidence"))
    return timeseries.best_date(o)


def change_points(spark, d):
    s = series(spark, d).withColumn("date", F.col("obs_time").cast("date"))
    return changepoint.change_points(s, "ndvi", penalty=1.0)


# --- patches --------------------------------------------------------------------------------------


def _rasters(spark, d):
    return catalogue(spark, d).filter("satellite = 'sentinel-2'").groupBy("cube_name").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def patch_grid(spark, d):
    return patches.patch_grid(_rasters(spark, d), CUBE, 100, 36)


def patch_classify(spark, d):
    return patches.patch_classes(patches.patch_grid(_rasters(spark, d), CUBE, SIZE), pixels(spark, d), CUBE, SIZE)


def patch_classify_overlapping(spark, d):
    return patches.patch_classes(patches.patch_grid(_rasters(spark, d), CUBE, 100, 36), pixels(spark, d), CUBE, 100, 36)


def patch_sample(spark, d):
    return patches.patch_sample(patch_classify(spark, d), CUBE).select("cube_name", "i", "j", "cls")


def patch_ratio_sample(spark, d):
    return patches.ratio_sample(patch_classify(spark, d), CUBE, (70, 30)).select("cube_name", "i", "j", "cls")


def _overlaps(spark, d):
    return zonal.overlap_shares(patch_extent(spark, d), annotations(spark, d), CUBE, F.struct("minx", "miny", "maxx", "maxy"))


def patch_balance(spark, d):
    """A patch counts once for every annotation with at least a tenth of its area in it."""
    held = _overlaps(spark, d).filter("share >= 0.1").groupBy("cube_name", "i", "j").agg(F.countDistinct("ann_id").alias("n_ann"))
    tasks = patch_classify(spark, d).join(held, ["cube_name", "i", "j"], "left").withColumn("n_ann", F.coalesce("n_ann", F.lit(0)))
    return patches.patch_balance(tasks, CUBE).filter("keep").select("cube_name", "i", "j", "n_ann")


def patch_arrays(spark, d):
    a = patches.patch_arrays(patch_classify(spark, d), pixels(spark, d), CUBE, SIZE, ["b02", "b04", "b08", "scl", "mask"], "date")
    return a.select("cube_name", "i", "j", "date", "band", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"))


def patch_arrays_overlapping(spark, d):
    a = patches.patch_arrays(patch_classify_overlapping(spark, d), pixels(spark, d), CUBE, 100, ["b04", "mask"], "date", overlap=36)
    return a.select("cube_name", "i", "j", "date", "band", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"))


def patch_extent(spark, d):
    t = catalogue(spark, d).filter("satellite = 'sentinel-2'").groupBy("cube_name").agg(F.max("geotransform").alias("t"), F.max("width").alias("width"), F.max("height").alias("height"))
    g = patches.patch_grid(t, CUBE, SIZE).join(t.select("cube_name", "t"), "cube_name")
    return g.select("cube_name", "i", "j", I.window_extent(F.col("t"), F.col("i"), F.col("j"), F.col("w"), F.col("h")).alias("_e")).select("cube_name", "i", "j", "_e.*")


def annotation_overlap(spark, d):
    return _overlaps(spark, d).filter("share >= 0.1").select("cube_name", "i", "j", "ann_id", r("share", 4).alias("share"))


def window_best_date(spark, d):
    """Annotations meeting a patch, with the best of their candidate dates; null without any."""
    met = _overlaps(spark, d).filter("share > 1e-9").select("cube_name", "i", "j", "ann_id").distinct()
    return met.join(best_date(spark, d), "ann_id", "left")


def window_dates_missing(spark, d):
    """The report beside it: annotations in a patch that have no candidate date, and in how many."""
    met = _overlaps(spark, d).filter("share > 1e-9").select("cube_name", "i", "j", "ann_id").distinct()
    return met.join(best_date(spark, d).filter("best_date is not null"), "ann_id", "left_anti").groupBy("ann_id").agg(F.count(F.lit(1)).alias("n_windows"))


def scene_chunks(spark, d):
    ranked = bucketed_rank(catalogue(spark, d), [], F.substring("scene_id", 1, 6), [F.col("scene_id")], "rn")
    return ranked.select("scene_id", raster.chunk_number(F.col("rn") - 1, 7).alias("chunk"))


def pipeline_change_dates(spark, d):
    return pipelines.change_dates(pixels(spark, d), annotations(spark, d), CUBE)


def pipeline_patches(spark, d):
    z = pipelines.training_patches(_rasters(spark, d), pixels(spark, d), CUBE, SIZE, ["b02", "b04"])
    return z.select("cube_name", "i", "j", "cls", "date", "band", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        scene_catalogue, band_parse, band_parse_old, band_lookup, cube_date_range, incomplete_scenes, scene_resolution, scene_removed, sensors_united, bad_pixel_ratio, time_mask, closest_image, monthly_timeseries, timeseries_pad,
        event_timeseries, event_timeseries_padded, ndvi_current, ndvi_old, ndwi, cross_ratio, linear_to_db, mean_sar, minmax, minmax_global, indices_added, zscore, contrast_stretch, histogram_300, stacked_bands, tile_round_trip, resample_bilinear, geotiff_pixels, stack_aligned, patch_window,
        annotation_boxes, pixel_in_annotation, pixel_touches_annotation, rasterize_mask, mask_attached, zonal_ndvi_gated, ring_ndvi, buffer_ladder_ndvi, dating_map, spectral_signature, band_means, signature_pivot,
        signature_json, scl_histogram, scl_map, ann_bad_pixel_filter, class_ring, nearby_ndvi, extent_pixels, annotations_reprojected, despike, cdndvi, slope_changes, best_date, change_points, patch_grid,
        patch_classify, patch_classify_overlapping, patch_sample, patch_ratio_sample, patch_balance, patch_arrays, patch_arrays_overlapping, patch_extent, annotation_overlap, window_best_date, window_dates_missing, scene_chunks, pipeline_change_dates, pipeline_patches,
    )
}
