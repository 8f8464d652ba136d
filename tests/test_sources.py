import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoraster.sources import cube, geotiff, scene_folders, shapefile, sinks
from chronoraster.streaming import ingest


@pytest.mark.parametrize("kw", [{}, {"deflate": False}, {"tile": 16}, {"predictor": True}, {"tile": 16, "predictor": True}])
@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4"])
def test_geotiff_round_trip(spark, tmp_path, kw, dtype):
    if kw.get("predictor") and dtype == "f4":
        pytest.skip("differencing is for whole numbers")
    rng = np.random.default_rng(0)
    bands = [rng.integers(0, 100, (37, 21)).astype(dtype) for _ in range(2)]
    (tmp_path / "a.tif").write_bytes(geotiff.encode(bands, (10, 0, 200000, 0, -10, 9300000), 32632, ["B02", "SCL"], "2019-05-09", 7, **kw))
    geotiff.register(spark)
    df = spark.read.format("geotiff").option("slice_mb", 0.0004).load(f"{tmp_path}/*.tif")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    for source in (df, geotiff.decode_files(files)):
        got = [np.full((37, 21), np.nan) for _ in bands]
        for r in source.collect():
            v = np.array([np.nan if x is None else x for x in r["values"]]).reshape(r.h, r.w)
            got[r.band - 1][r.row_off : r.row_off + r.h, r.col_off : r.col_off + r.w] = v
            assert (r.description, r.time, r.epsg, r.transform.c, r.width) == (["B02", "SCL"][r.band - 1], "2019-05-09", 32632, 200000.0, 21)
        for g, b in zip(got, bands):
            assert np.array_equal(g, np.where(b == 7, np.nan, b.astype(float)), equal_nan=True)


def test_geotiff_refuses_what_it_cannot_read():
    with pytest.raises(ValueError):
        geotiff.Tiff(io.BytesIO(b"no tiff at all.."))


def test_window_and_bands_are_read_alone(spark, tmp_path):
    rng = np.random.default_rng(3)
    grids = [rng.integers(1, 100, (70, 50)).astype("u2") for _ in range(3)]
    (tmp_path / "a.tif").write_bytes(geotiff.encode(grids, (10, 0, 0, 0, -10, 0), 32632, ["B02", "B04", "SCL"], "2019-05-09", tile=16))
    geotiff.register(spark)
    df = spark.read.format("geotiff").option("bands", "B04, SCL").option("window", "40,10,30,20").load(f"{tmp_path}/*.tif")
    rows = df.collect()
    assert {r.description for r in rows} == {"B04", "SCL"} and len(rows) == 2 * 2 * 2  # blocks 2..3 across, cut by the raster, 0..1 down
    got = {r.band: np.array(r["values"]) for r in cube.window_patch(df, ["path"], 40, 10, 32).collect() if r.band == "B04"}
    want = np.zeros((32, 32))
    want[:20, :10] = grids[1][10:30, 40:50]
    assert np.array_equal(got["B04"].reshape(32, 32), want)  # beyond the raster and the option's window: 0


def test_pixels_of_files_have_places_dates_and_bands(spark, tmp_path):
    rng = np.random.default_rng(4)
    for k in range(2):
        grids = [rng.integers(0, 9, (5, 4)).astype("i2") for _ in range(2 - k)]
        grids[0][2, 3] = -9999
        (tmp_path / f"s{k}.tif").write_bytes(geotiff.encode(grids, (10, 0, 1000, 0, -10, 2000), 32632, ["B02", "B04"][: 2 - k], f"2019-05-0{k + 1}", -9999))
    geotiff.register(spark)
    px = cube.load_pixels(spark.read.format("geotiff").load(f"{tmp_path}/*.tif"), ["B02", "B04"]).collect()
    assert len(px) == 39  # the second file has no other band beside its no-data cell
    p = next(r for r in px if r.path.endswith("s0.tif") and (r.row_idx, r.col_idx) == (2, 3))
    assert (p.x, p.y, str(p.date), p.B02) == (1035.0, 1975.0, "2019-05-01", None) and p.B04 is not None
    assert all(r.B04 is None for r in px if r.path.endswith("s1.tif"))
    assert cube.load_pixels(spark.createDataFrame([], geotiff.SCHEMA), ["B02"]).count() == 0


def test_bands_of_another_grid_are_brought_to_the_first_ones(spark, tmp_path):
    rng = np.random.default_rng(5)
    fine, coarse, scl = rng.integers(1, 100, (6, 8)).astype("f8"), rng.integers(1, 100, (3, 4)).astype("f8"), rng.integers(0, 11, (3, 4)).astype("f8")
    for name, grid, size in (("B02", fine, 10), ("B11", coarse, 20), ("SCL", scl, 20)):
        (tmp_path / f"x_{name}.tif").write_bytes(geotiff.encode([grid], (size, 0, 1000, 0, -size, 2000), 32632, [name], "2019-05-01"))
    geotiff.register(spark)
    rows = spark.read.format("geotiff").load(f"{tmp_path}/*.tif").withColumn("scene", F.lit("s"))
    got = {(r.row_idx, r.col_idx): r for r in cube.align(cube.band_pixels(rows, ["scene"]), ["scene"], ["B02", "B11", "SCL"]).collect()}
    assert len(got) == 48
    for (i, j), r in got.items():
        v, u = (i + 0.5) / 2 - 0.5, (j + 0.5) / 2 - 0.5
        near = [(a, b, (1 - abs(v - a)) * (1 - abs(u - b))) for a in range(3) for b in range(4) if abs(v - a) < 1 and abs(u - b) < 1]
        assert r.B02 == fine[i, j] and abs(r.B11 - sum(w * coarse[a, b] for a, b, w in near) / sum(w for *_, w in near)) < 1e-9
        assert r.SCL == scl[i // 2, j // 2]


def test_lzw():
    codes = [256, 65, 66, 258, 260, 257]  # A B AB ABA
    bits = "".join(f"{c:09b}" for c in codes)
    assert geotiff.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == b"ABABABA"


def test_shapefile(spark, tmp_path):
    path = str(tmp_path / "a.shp")
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    shapefile.write_shapefile(path, [[ring], None, [ring, ring]], [("id", "N", 9, 0), ("pre_date", "D", 8, 0), ("name", "C", 10, 0)], [(1, "20200131", "x"), (2, None, None), (3, "bad", "z")])
    assert shapefile.first_shapefile(str(tmp_path)) == path
    shapefile.register(spark)
    rows = spark.read.format("shapefile").option("records_per_task", 2).load(path).orderBy("record").collect()
    assert [(r.id, str(r.pre_date), r.name) for r in rows] == [(1, "2020-01-31", "x"), (2, "None", None), (3, "None", "z")]
    assert rows[1].rings is None and len(rows[2].rings) == 2 and tuple(rows[0].rings[0][1]) == (0.0, 1.0)
    kept = shapefile.load_annotations(spark, path).collect()
    assert [r.id for r in kept] == [1, 3] and kept[0].crs is None
    with pytest.raises(FileNotFoundError):
        shapefile.first_shapefile(str(tmp_path / "none"))


def test_scene_folders(spark, tmp_path):
    for p in ["s2/a/X_20190509_B02.tif", "s2/a/X_20190509_SCL.tif", "s2/b/X_nodate_B02.tif", "s2/b/readme.tif", "s1/q/s1_20170219t09_x_vv_dsc.tif", "s1/q/s1_20170219t09_x_vh_dsc.tif", "m/x_mask.tif"]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")  # empty files are passed over by the listing
    s2 = {r.scene_id: r for r in scene_folders.optical_scenes(scene_folders.band_files(spark, f"{tmp_path}/s2")).collect()}
    assert set(s2) == {"a", "b"} and str(s2["a"].scene_date) == "2019-05-09" and set(s2["a"].band_paths) == {"B02", "SCL"} and s2["b"].bad_date
    s1 = scene_folders.radar_scenes(scene_folders.band_files(spark, f"{tmp_path}/s1")).first()
    assert (s1.orbit, str(s1.scene_date), set(s1.band_paths)) == ("dsc", "2017-02-19", {"VV", "VH"})
    assert scene_folders.mask_file(scene_folders.band_files(spark, str(tmp_path))).first().path.endswith("x_mask.tif")


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "cube")
    df = spark.createDataFrame([(1, "B02", 5.0), (2, "B04", 6.0)], "id int, band string, v double")
    sinks.write_patches(df, f"{root}/patches")
    sinks.write_patches(df.limit(0), f"{root}/patches")  # present: stays
    assert sorted(map(tuple, sinks.read_patches(spark, f"{root}/patches").select("id", "band", "v").collect())) == [(1, "B02", 5.0), (2, "B04", 6.0)]
    sinks.write_patches(df.filter("id = 1"), f"{root}/patches", reset=True)
    assert sinks.read_patches(spark, f"{root}/patches").count() == 1
    with pytest.raises(ValueError):
        sinks.clean(spark, root, ["../x"])
    assert sinks.clean(spark, root, ["patches", "none"]) == ["patches"]


def test_signature_round_trip(spark, tmp_path):
    import datetime as dt

    from chronoraster.operators.zonal import signature_json

    long = spark.createDataFrame([(1, dt.date(2019, 5, 9), "B02", 0.5), (1, dt.date(2019, 5, 9), "B04", 1.5), (1, dt.date(2019, 6, 1), "B02", 2.5)], "ann_id bigint, date date, band string, mean double")
    sinks.write_signatures(signature_json(long), f"{tmp_path}/sig")
    assert sorted(map(tuple, sinks.read_signatures(spark, f"{tmp_path}/sig").collect())) == sorted(map(tuple, long.collect()))
    assert sinks.read_signatures(spark, f"{tmp_path}/none").count() == 0


def test_array_metadata(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "z/.zarray").write_text('{"shape": [3, 4], "chunks": [1, 4], "dtype": "<f8", "fill_value": "NaN"}')
    (tmp_path / "z/.zattrs").write_text('{"crs": "EPSG:32632"}')
    r = sinks.array_metadata(spark, str(tmp_path)).first()
    assert (r.shape, r.dtype, "32632" in r.attributes) == ([3, 4], "<f8", True)


def test_streaming(spark, tmp_path):
    s = spark.read.parquet("/root/testdata/sf0.001/ndvi_series.parquet")
    for k in range(3):  # the second delivery repeats the first
        s.filter(F.col("rec_id") % 2 == (0 if k < 2 else 1)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.scene_quality(ingest.readings(spark, str(tmp_path / "in"), late="4000 days", files_per_trigger=1))
    q = stream.writeStream.format("memory").queryName("quality").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert q.exception() is None
    finally:
        q.stop()
    batch = ingest.scene_quality(s.withColumn("obs_time", F.col("obs_time").cast("timestamp")))
    assert {(r.cube_name, r.start): r.n for r in spark.table("quality").collect()}.items() <= {(r.cube_name, r.start): r.n for r in batch.collect()}.items()
