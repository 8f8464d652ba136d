import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoraster.operators import patches, raster, scenes, zonal


def plain_bilinear(values: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear resampling of one array, the plain form that ``resample`` is tested against."""
    h, w = values.shape
    nh, nw = int(h * factor), int(w * factor)
    r, c = (np.arange(nh) + 0.5) / factor - 0.5, (np.arange(nw) + 0.5) / factor - 0.5
    out = np.full((nh, nw), np.nan)
    for a in range(nh):
        for b in range(nw):
            num = den = 0.0
            for y in (int(np.floor(r[a])), int(np.floor(r[a])) + 1):
                for x in (int(np.floor(c[b])), int(np.floor(c[b])) + 1):
                    wt = (1 - abs(r[a] - y)) * (1 - abs(c[b] - x))
                    if 0 <= y < h and 0 <= x < w and wt > 0 and not np.isnan(values[y, x]):
                        num, den = num + wt * values[y, x], den + wt
            out[a, b] = num / den if den else np.nan
    return out


def frame_of(values: np.ndarray, name: str = "v") -> pd.DataFrame:
    """Array as pixel rows."""
    r, c = np.indices(values.shape)
    return pd.DataFrame({"row_idx": r.ravel(), "col_idx": c.ravel(), name: values.ravel()})


def test_grid_keeps_edges_and_refuses_bad_overlap(spark):
    s = spark.createDataFrame([("c", 10, 7)], "cube_name string, width int, height int")
    g = patches.patch_grid(s, ["cube_name"], 4, 1).collect()
    assert len(g) == 12 and {(r.i, r.w) for r in g} == {(0, 4), (3, 4), (6, 4), (9, 1)} and {(r.j, r.h) for r in g} == {(0, 4), (3, 4), (6, 1)}
    for bad in (4, 5):
        with pytest.raises(ValueError):
            patches.patch_grid(s, ["cube_name"], 4, bad)


def test_classes_and_samples(spark):
    s = spark.createDataFrame([("c", 40, 40)], "cube_name string, width int, height int")
    mask = spark.createDataFrame([("c", 5 * k, 5 * k, 1) for k in range(7)] + [("c", 1, 30, 0), ("c", None, 3, 1), ("c", 2, 3, None)], "cube_name string, col_idx int, row_idx int, mask int")
    g = patches.patch_grid(s, ["cube_name"], 5)
    c = patches.patch_classes(g, mask, ["cube_name"], 5)
    assert {(r.i, r.j) for r in c.filter("cls = 'Annotation'").collect()} == {(5 * k, 5 * k) for k in range(7)}
    a = patches.patch_sample(c, ["cube_name"], 0.3)
    assert a.filter("cls <> 'Annotation'").count() == 2 and a.count() == 9
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, patches.patch_sample(c, ["cube_name"], 0.3).collect()))
    with pytest.raises(ValueError):
        patches.patch_sample(c, ["cube_name"], 100.0)
    for r0, r1 in ((70, 30), (100, 0), (50, 50)):
        n = patches.ratio_sample(c, ["cube_name"], (r0, r1))
        assert n.filter("cls <> 'Annotation'").count() == int(7 / r0 * r1)


def greedy(counts, ratio):
    p = e = 0
    keep = []
    for n in counts:
        share = p / (p + e) if p + e else 1
        keep.append(bool(n) or share > ratio)
        p, e = p + n, e + (not n and share > ratio)
    return keep


@pytest.mark.parametrize("ratio", [0.2, 0.5, 0.8, 1.0, 1.2])
def test_balance_is_the_greedy_scan(spark, ratio):
    rng = random.Random(4)
    cases = [[rng.choice([0, 0, 0, 1, 2]) for _ in range(40)] for _ in range(12)] + [[0, 0, 2, 0, 0, 1, 0]]
    df = spark.createDataFrame([(k, i, 0, n) for k, c in enumerate(cases) for i, n in enumerate(c)], "k int, i int, j int, n_ann int")
    got = patches.patch_balance(df, ["k"], ann_ratio=ratio).collect()
    for k, c in enumerate(cases):
        assert [r.keep for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)] == greedy(c, ratio)


def test_patch_arrays_are_padded_with_zeros(spark):
    s = spark.createDataFrame([("c", 6, 4)], "cube_name string, width int, height int")
    px = spark.createDataFrame([("c", 5, 1, 7.0, "t"), ("c", 0, 0, None, "t"), ("c", 1, 0, 3.0, "t"), ("c", None, 0, 3.0, "t")], "cube_name string, col_idx int, row_idx int, b04 double, obs_time string")
    got = {r.i: list(r["values"]) for r in patches.patch_arrays(patches.patch_grid(s, ["cube_name"], 4), px, ["cube_name"], 4, ["b04"]).collect()}
    assert got[0][:2] == [0.0, 3.0] and got[4][1 * 4 + 1] == 7.0 and sum(got[4]) == 7.0 and len(got[4]) == 16


def test_resample_is_bilinear(spark):
    a = np.random.default_rng(0).uniform(0, 100, (5, 6))
    a[2, 3] = np.nan
    df = spark.createDataFrame(frame_of(a)).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumns({"g": F.lit(1), "scl": F.lit(4)})
    for f in (2.0, 0.5, 1.0):
        want = plain_bilinear(a, f)
        got = np.full(want.shape, np.nan)
        for r in raster.resample(df, ["g"], ["v", "scl"], f).collect():
            if r.row_idx < got.shape[0] and r.col_idx < got.shape[1] and r.v is not None:
                got[r.row_idx, r.col_idx] = r.v
        assert np.allclose(got, want, equal_nan=True)


def test_tiles_round_trip(spark):
    px = spark.createDataFrame([("s", c, r, float(c * 100 + r), None) for c in range(7) for r in range(5)], "scene_id string, col_idx int, row_idx int, a double, b double")
    back = raster.to_pixels(raster.to_tiles(px, ["a", "b"], ["scene_id"], 4), ["a", "b"], ["scene_id"])
    assert sorted(map(tuple, back.select("scene_id", "col_idx", "row_idx", "a", "b").collect()), key=str) == sorted(map(tuple, px.collect()), key=str)


def test_contrast_and_fill_value(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    got = [r.stretched for r in raster.contrast_stretch(df, [], "v", 0.1, 0.9).orderBy("v").collect()]
    assert np.allclose(got, (np.arange(11) - 1) / 8)
    assert raster.with_fill_value(df, ["v"]).schema["v"].metadata == {"_FillValue": -9999.0}
    assert {r.scaled for r in raster.scaled(spark.createDataFrame([("s", 2.0), ("s", 2.0)], "s string, v double"), ["s"], "v").collect()} == {None}


def test_scene_padding(spark):
    import datetime as dt

    s = spark.createDataFrame([("c", f"s{k}", dt.date(2020, 1, 1 + k)) for k in range(4)], "cube_name string, scene_id string, scene_date date")
    p = scenes.pad_scenes(s.filter("scene_id in ('s1', 's2')"), s, 5, ["cube_name"])
    assert sorted((r.scene_id, r.padding) for r in p.collect()) == [("s0", True), ("s1", False), ("s2", False), ("s3", True), ("s3", True)]
    t = scenes.scenes_per_month(s, spark.createDataFrame([("s0", 9.0), ("s1", 1.0)], "scene_id string, bad_ratio double"), 3, ["cube_name"])
    assert t.count() == 3 and {"s0", "s1"} <= {r.scene_id for r in t.collect()}


def test_duplicate_scenes_and_missing_bands(spark):
    s = spark.createDataFrame([("a", "x", {"B02": "p"}), ("a", "x", {"B02": "p"}), ("b", None, None), (None, "y", {})], "scene_id string, orbit string, band_paths map<string,string>")
    d = scenes.distinct_scenes(s)
    assert sorted(r.scene_id for r in d.collect()) == ["a", "b"]
    assert {r.scene_id: r.missing for r in scenes.incomplete_scenes(d, ["B02", "SCL"]).collect()} == {"a": ["SCL"], "b": ["B02", "SCL"]}


def test_zonal_nulls_and_empty(spark):
    px = spark.createDataFrame([(1, "c", 5.0, 5.0, 4, 0.5), (2, "c", 6.0, 5.0, None, 0.5), (3, "c", 7.0, 5.0, 8, 0.1), (4, None, 5.0, 5.0, 4, 0.9), (5, "c", None, 5.0, 4, 0.9)], "pixel_id int, cube_name string, x double, y double, scl int, ndvi double")
    ann = spark.createDataFrame([(1, "c", [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]), (2, "c", None), (3, "c", [[]])], "id bigint, cube_name string, rings array<array<struct<x:double,y:double>>>")
    inside = zonal.pixels_in(px, ann, ["cube_name"])
    assert sorted(r.pixel_id for r in inside.collect()) == [1, 2, 3]
    r = zonal.gated_ndvi(inside, ["ann_id"]).first()
    assert (r["mean"], r["median"], r.n) == (None, None, 2)
    assert zonal.gated_ndvi(inside, ["ann_id"], threshold=50.0).first()["mean"] == 0.5
    assert zonal.pixels_in(px.limit(0), ann, ["cube_name"]).count() == 0
    assert raster.rasterize(px, ann, ["cube_name"]).groupBy().agg(F.sum("value")).first()[0] == 3
    own = zonal.gated_ndvi(inside, ["ann_id"], threshold=0.0)
    near = zonal.pixels_around(px, ann, ["cube_name"], -1.0, 500.0)
    g = zonal.growing_buffer_ndvi(near, own, ["ann_id"], factor=5).first()
    assert (g.radius, g["mean"]) == (None, None)  # one vegetation pixel is not five times two
    assert zonal.growing_buffer_ndvi(near, own.withColumn("n", F.lit(0)), ["ann_id"]).first().radius == 100.0
