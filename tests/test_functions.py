import math
import random

import pytest
from pyspark.sql import functions as F

from chronoraster.functions import geometry as G
from chronoraster.functions import indices as I
from chronoraster.functions import names as N
from chronoraster.functions.predicates import good_gate, positive_mean, time_valid


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if not isinstance(v, str) else 'string'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize("nir,red,want", [(12000.0, 2000.0, 2 / 3), (4000.0, 1000.0, 0.6), (-5.0, 100.0, -1.0), (0.0, 0.0, None), (None, 1.0, None)])
def test_current_ndvi(spark, nir, red, want):
    got = one(spark, I.ndvi(F.col("n"), F.col("r")), n=nir, r=red)
    assert got is None if want is None else got == pytest.approx(want)


def test_other_indices(spark):
    assert one(spark, I.ndvi_raw(F.col("n"), F.col("r")), n=0.0, r=0.0) == 0.0
    assert one(spark, I.ndwi(F.col("n"), F.col("r")), n=math.inf, r=2.0) == pytest.approx(-1.0)
    assert [one(spark, I.linear_to_db(F.col("x")), x=x) for x in (10.0, 1.0, 0.0, -3.0)] == [10.0, 0.0, None, None]
    assert one(spark, I.cross_ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None


def test_transforms(spark):
    t = spark.createDataFrame([("200000 10 0 9300000 0 -10",)], "g string").select(I.reordered_transform(F.col("g")).alias("t"))
    r = t.select("t.*", I.resolution(F.col("t")).alias("r"), I.window_transform(F.col("t"), F.lit(64), F.lit(2)).alias("w"), I.window_extent(F.col("t"), F.lit(0), F.lit(0), F.lit(4), F.lit(4)).alias("ext"),
                 I.rescaled_grid(F.col("t"), F.lit(11), F.lit(5), 20.0).alias("s")).first()
    assert (r.a, r.b, r.c, r.d, r.ext.miny, r.f) == (10, 0, 200000, 0, 9299960, 9300000)
    assert tuple(r.r) == (10, 10) and (r.w.c, r.w.f) == (200640, 9299980)
    assert (r.s.width, r.s.height, r.s.a) == (5, 2, 20.0)


def test_names(spark):
    p = "/b/sentinel-2/images/s/S2_x_20190509_B8A.tif"
    s1 = "s1a_iw_nrb_20170219t095846_015351_0192dd_20ppc-20ppb_vv_dsc"
    df = spark.createDataFrame([(p, s1)], "p string, s string")
    r = df.select(
        N.s2_band(F.col("p")).alias("b"), N.band_rank(N.s2_band(F.col("p"))).alias("k"), N.band_digits_rank(F.lit("B8A")).alias("d"), N.s2_scene_name(N.stem(F.col("p"))).alias("n"),
        N.s2_scene_date(N.s2_scene_name(N.stem(F.col("p")))).alias("dt"), N.s1_band(F.concat("s", F.lit(".tif"))).alias("pol"), N.orbit(F.col("s")).alias("o"), N.s1_scene_date(F.col("s")).alias("sd"),
        N.s1_scene_name(F.col("s")).alias("sn"), N.is_number(F.lit("1e3")).alias("x"), N.is_number(F.lit("a")).alias("y"), N.s2_band(F.lit("b02.tif")).alias("z"), N.band_rank(F.lit(None).cast("string")).alias("u"),
    ).first()
    assert (r.b, r.k, r.d, r.n, str(r.dt)) == ("B8A", 9, 8, "S2_x_20190509", "2019-05-09")
    assert (r.pol, r.o, str(r.sd), r.sn) == ("VV", "dsc", "2017-02-19", "s1a_iw_nrb_20170219t095846_015351_0192dd_20ppc-20ppb")
    assert r.x and not r.y and r.z is None and r.u == N.LAST_RANK


def test_gates(spark):
    df = spark.createDataFrame([(4,), (5,), (7,), (8,), (None,)], "scl int")
    assert df.select(time_valid(F.col("scl")).alias("v")).first().v is False  # half is not more than half
    assert one(spark, good_gate(F.lit(70), F.lit(100))) and not one(spark, good_gate(F.lit(0), F.lit(0)))
    v = spark.createDataFrame([(0,), (-9999,), (4,), (6,)], "v int")
    assert v.select(positive_mean(F.col("v")).alias("m")).first().m == 5.0
    assert v.filter("v <= 0").select(positive_mean(F.col("v")).alias("m")).first().m == 0.0


RING = "rings array<array<struct<x:double,y:double>>>"
SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]


def test_geometry(spark):
    df = spark.createDataFrame([(SQUARE,)], RING).withColumn("e", G.edges(F.col("rings")))
    at = lambda f, x, y, *a: df.select(f(F.col("e"), F.lit(x), F.lit(y), *a).alias("v")).first().v
    assert at(G.contains, 1.0, 1.0) and not at(G.contains, 5.0, 5.0) and not at(G.contains, 11.0, 5.0)
    assert at(G.distance, 13.0, 14.0) == 5.0 and at(G.distance, 5.0, 5.0) == 1.0 and at(G.distance, 2.0, 2.0) == 0.0
    assert at(G.touches_square, 14.9, 5.0, 5.0) and not at(G.touches_square, 15.1, 5.0, 5.0) and at(G.touches_square, 50.0, 50.0, 45.0)
    b = df.select(G.bounding_box(F.col("rings"), 2.0).alias("b")).first().b
    assert tuple(b) == (-2.0, -2.0, 12.0, 12.0)


def test_overlap_and_repair(spark):
    df = spark.createDataFrame([(SQUARE, (0.0, 0.0, 5.0, 10.0)), ([], (0.0, 0.0, 1.0, 1.0))], RING + ", b struct<minx:double,miny:double,maxx:double,maxy:double>")
    s = G.signed_rings(F.col("rings"))
    got = [tuple(r) for r in df.select(G.area_in_box(s, F.col("b")), G.area_in_box(s)).collect()]
    assert got == [(pytest.approx(50 - 2), pytest.approx(96)), (0.0, 0.0)]
    bad = spark.createDataFrame([([[(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, None), (1.0, 1.0)], [(0.0, 0.0)], None],), ([[]],), (None,)], RING)
    fixed = [r.v for r in bad.select(G.repair(F.col("rings")).alias("v")).collect()]
    assert [[tuple(p) for p in r] for r in fixed[0]] == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]] and fixed[1:] == [None, None]


def clipped(ring, box):
    """Area of a ring cut by the four sides of a box, one after the other."""
    p = list(ring)
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(p, p[1:] + p[:1]):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            out += [a] if ina else []
            if ina != inb:
                f = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
        p = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2


def test_area_in_a_box_equals_clipping(spark):
    rng = random.Random(9)
    data = []
    for _ in range(60):
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.choice([3, 5, 12])))
        data.append(([[(500 + rng.uniform(20, 90) * math.cos(a), 9000 + rng.uniform(20, 90) * math.sin(a)) for a in at]], [500 + rng.uniform(-90, 60), 9000 + rng.uniform(-90, 60)]))
    boxes = [(r, (x, y, x + 50.0, y + 30.0)) for r, (x, y) in data]
    df = spark.createDataFrame(boxes, RING + ", b struct<minx:double,miny:double,maxx:double,maxy:double>")
    got = [r.v for r in df.select(G.area_in_box(G.signed_rings(F.col("rings")), F.col("b")).alias("v")).collect()]
    assert got == [pytest.approx(clipped(r[0], b), abs=1e-6) for r, b in boxes] and sum(g > 0 for g in got) > 20


def test_utm(spark):
    df = spark.createDataFrame([(9.0, 48.0), (11.5, -33.25)], "lon double, lat double")
    p = df.withColumn("u", G.to_utm(F.col("lon"), F.col("lat"), 32)).withColumn("g", G.from_utm(F.col("u.x"), F.col("u.y"), 32)).collect()
    assert p[0].u.x == pytest.approx(500000, abs=1e-6) and p[0].u.y == pytest.approx(5316300.222, abs=1.0)
    for r in p:
        assert (r.g.x, r.g.y) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))
    with pytest.raises(ValueError):
        G.reproject(F.col("rings"), "32632", "3857")
