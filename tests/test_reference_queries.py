import datetime as dt
import math
import random

from pyspark.sql import functions as F

from chronoraster.functions import geometry as G
from chronoraster.operators import zonal
from chronoraster.plans import reference_queries as Q

SMALL = "/root/testdata/sf0.001"


def test_the_ladder_asks_for_five_times_the_pixels_up_to_the_rasters_extent(spark):
    own = zonal.gated_ndvi(Q._inside(spark, SMALL), ["ann_id", "date"])
    n = {(r.ann_id, r.date): r.n for r in own.collect()}
    v = Q.pixels(spark, SMALL).filter("scl = 4 and ndvi is not null and x is not null and y is not null")
    shapes = Q.annotations(spark, SMALL).select("cube_name", F.col("id").alias("ann_id"), G.edges(F.col("rings")).alias("e"))
    met = v.join(shapes, "cube_name").select("ann_id", "date", G.distance(F.col("e"), F.col("x"), F.col("y")).alias("dist"))
    dist = {}
    for r in met.filter("dist is not null").collect():
        dist.setdefault((r.ann_id, r.date), []).append(r.dist)
    want = {}
    for k, of in n.items():
        here = dist.get(k, [])
        enough = [r for r in (100 * 1.5**j for j in range(30)) if sum(x <= r for x in here) >= max(1, 5 * of)]
        want[k] = enough[0] if enough and min(here) <= 337.5 else None
    got = {(r.ann_id, r.date): r.radius for r in Q.buffer_ladder_ndvi(spark, SMALL).collect()}
    assert got == want and Q._rungs(spark, SMALL) > 8


def test_the_ladder_of_a_crowded_day_pairs_annotations_with_what_decides_them(spark, tmp_path):
    rnd, day = random.Random(5), dt.datetime(2018, 5, 1)
    at = [(200005.0 + 10 * rnd.randrange(2500), 9290005.0 + 10 * rnd.randrange(2500)) for _ in range(900)] + [(600005.0 + 10 * k, 9290005.0) for k in range(20)]
    shapes = []
    for k, (x, y) in enumerate(at[::9]):
        size = 6.0 if k % 5 else rnd.uniform(50, 900)
        ring = [(x + size * math.cos(a) * rnd.uniform(0.95, 1), y + size * math.sin(a)) for a in (0.3, 1.4, 2.6, 3.9, 5.2)]
        shapes.append((k, "c", [[{"x": px, "y": py} for px, py in ring]], None, None, "EPSG:32633"))
    shapes.append((500, "c", None, None, None, "EPSG:32633"))
    spark.createDataFrame(shapes, "id long, cube_name string, rings array<array<struct<x: double, y: double>>>, pre_date date, post_date date, crs string").write.parquet(f"{tmp_path}/annotations.parquet")
    # the second day has few pixels, and of the first every third is no vegetation
    rows = [(i, "c", "s", day + dt.timedelta(days=int(i % 90 == 5)), 0, 0, x, y, 0, 0, 1, 1.0, 900.0, 2000.0 + i, 5 if i % 3 == 1 else 4, 0) for i, (x, y) in enumerate(at)]
    rows += [(i, "c", "s", day, 0, 0, x, y, 0, 0, 1, 1.0, 900.0, 3000.0, 4, 0) for i, (x, y) in ((2000, (float("nan"), 9290005.0)), (2001, (None, 9290005.0)))]
    schema = "pixel_id long, cube_name string, scene_id string, obs_time timestamp, row_idx int, col_idx int, x double, y double, tile_i int, tile_j int, id long, b02 double, b04 double, b08 double, scl int, mask int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/xds_pixels.parquet")
    size = "named_struct('a', 10D, 'b', 0D, 'c', 200000D, 'd', 0D, 'e', -10D, 'f', 9300000D)"
    both = [f"select 's' scene_id, {size} geotransform, {w} width, 100 height" for w in (60000, 9)]
    spark.sql(" union all ".join([*both, f"select null, {size}, 900000, 1"])).write.parquet(f"{tmp_path}/scenes.parquet")
    d, by = str(tmp_path), ["ann_id", "date"]
    # the first of both rows of the scene counts
    first = Q.catalogue(spark, d).select("width").first().width
    assert Q._rungs(spark, d) == max(8, 1 + math.ceil(math.log(math.hypot(10 * first, 1000) / 100, 1.5)))
    own, rungs = zonal.gated_ndvi(Q._inside(spark, d), by).cache(), 23
    dated = Q.annotations(spark, d).join(own.select(F.col("ann_id").alias("id"), "date"), "id")
    outer = 100 * 1.5 ** (rungs - 1)
    every = zonal.pixels_around(Q.pixels(spark, d).filter("scl = 4"), dated, ["cube_name", "date"], -1.0, outer, cell=2 * outer).cache()
    some = Q._vegetation_near(spark, d, own, rungs).cache()
    found = lambda near: {(r.ann_id, r.date): (r.radius, r["mean"] and round(r["mean"], 9), r["median"]) for r in zonal.growing_buffer_ndvi(near, own, by, rungs=rungs).collect()}
    want = found(every)
    assert found(some) == want and len({r for r, _, _ in want.values()}) > 5
    assert some.count() * 5 < every.count()


def test_the_dating_map_finds_the_pixels_of_the_annotations_once(spark):
    z = Q.dating_map(spark, SMALL)
    ladder = {(r.ann_id, r.date): (r["mean"], r["median"]) for r in Q.buffer_ladder_ndvi(spark, SMALL).collect()}
    assert {(r.ann_id, r.date): (r.buf_mean, r.buf_median) for r in z.collect()} == ladder and len(ladder) > 0
    # the result joins kept tables only, so its plan reads no raster or polygon anew
    assert not any(f.split("/")[-1] in ("xds_pixels.parquet", "annotations.parquet") for f in z.inputFiles())


def test_the_pivot_holds_every_annotation_and_date(spark):
    long = Q.spectral_signature(spark, SMALL).filter("band = 'b04' and date is not null").select("ann_id", F.date_format("date", "yyyyMMdd").alias("d"), "mean").collect()
    rows = {r.ann_id: r.asDict() for r in Q.signature_pivot(spark, SMALL).collect()}
    assert len(long) > 0 and {r.ann_id for r in long} <= set(rows)
    assert all(rows[r.ann_id][r.d] == r["mean"] for r in long)
    assert sum(v is not None for r in rows.values() for k, v in r.items() if k != "ann_id") == len(long)


def test_annotations_of_every_utm_zone_are_reprojected(spark):
    a = Q.annotations(spark, SMALL).select("id", Q.crs_code("crs").alias("code"), G.bounding_box(F.col("rings")).alias("b")).filter("b.minx is not null")
    want = {r.id: r.code for r in a.collect() if r.code in ("32632", "32633")}
    got = {r.id: r.lon for r in Q.annotations_reprojected(spark, SMALL).collect()}
    assert set(want.values()) == {"32632", "32633"} and set(got) == set(want)
    for code in ("32632", "32633"):
        alone = Q.annotations(spark, SMALL).filter(Q.crs_code("crs") == code).select("id", G.bounding_box(G.reproject(F.col("rings"), code, "4326")).minx.alias("lon"))
        assert all(abs(got[r.id] - r.lon) < 1e-6 for r in alone.filter("lon is not null").collect())


def test_arrays_hold_all_bands_and_patches_and_padding_all_months(spark):
    a = Q.patch_arrays(spark, SMALL).select("cube_name", "i", "j", "band").distinct().collect()
    bands = {}
    for r in a:
        bands.setdefault((r.cube_name, r.i, r.j), set()).add(r.band)
    cls = {(r.cube_name, r.i, r.j): r.cls for r in Q.patch_classify(spark, SMALL).collect() if (r.cube_name, r.i, r.j) in bands}
    assert set(cls.values()) == {"Annotation", "No-Annotation"} and all(b == {"b02", "b04", "b08", "scl", "mask"} for b in bands.values())
    dated = {r.scene_id for r in Q.catalogue(spark, SMALL).filter("satellite = 'sentinel-2' and scene_date is not null").collect()}
    assert {r.scene_id for r in Q.timeseries_pad(spark, SMALL).filter("not padding").collect()} == dated
