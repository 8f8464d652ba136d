import itertools
import random

import numpy as np

from chronoraster.operators import proximity
from chronoraster.operators.proximity import containing_regions, crs_code, near_pairs

ANN = "id bigint, cube_name string, rings array<array<struct<x:double,y:double>>>, crs string, cx string"


def box(x, y, h=5.0):
    return [[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]]


def test_spellings_of_one_system(spark):
    df = spark.createDataFrame([(s,) for s in ["EPSG:32632", "32632", "epsg:32632", "urn:ogc:def:crs:EPSG::32632", "WGS 84 / UTM zone 32N", " EPSG: 32632 "]], "crs string")
    assert {r[0] for r in df.select(crs_code("crs")).collect()} == {"32632"}
    other = spark.createDataFrame([("WGS 84 / UTM zone 5S",), (None,), ("  ",), ("local grid",)], "crs string")
    assert [r[0] for r in other.select(crs_code("crs")).collect()] == ["32705", None, None, "LOCALGRID"]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    pts = [(k, rng.uniform(0, 3000), rng.uniform(0, 3000), rng.choice(["EPSG:32632", "32632", "32633"])) for k in range(400)]
    df = spark.createDataFrame([(k, "c", box(x, y), c, "clash") for k, x, y, c in pts], ANN)
    want = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if (a[3][-5:] == b[3][-5:]) and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 250**2}
    assert {(r.id_a, r.id_b) for r in near_pairs(df, 250.0).collect()} == want
    assert {(r.id_a, r.id_b) for r in near_pairs(df, 250.0, hot_rows=3).collect()} == want  # every cell is hot


def test_exact_distance_counts_and_degenerate_rows_do_not(spark):
    df = spark.createDataFrame(
        [(1, "c", box(0, 0), "32632", None), (2, "c", box(250, 0), "EPSG:32632", None), (3, "c", box(0, 250.01), "32632", None), (4, None, box(0, 0), None, None), (5, "c", None, "32632", None), (6, "c", [[]], "32632", None),
         (7, "c", [[(None, 1.0), (float("nan"), 2.0)]], "32632", None), (None, "c", box(0, 0), "32632", None), (1, "c", box(0, 0), "32632", None), (8, "c", box(0, 0), "32632", None)],
        ANN,
    )
    got = sorted((r.id_a, r.id_b) for r in near_pairs(df, 250.0).collect())
    assert got == [(1, 2), (1, 8), (2, 8)]


def test_empty(spark):
    assert near_pairs(spark.createDataFrame([], ANN), 250.0).count() == 0


def inside(x, y, rings):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ax <= x < bx or bx <= x < ax) and ay + (by - ay) * (x - ax) / (bx - ax) <= y:
                odd = not odd
    return odd


def test_polygons_with_holes_pieces_and_crossings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    shapes = []
    for k in range(25):
        cx, cy = map(float, rng.uniform(0, 2000, 2))
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(50, 300, 9)
        outer = [(float(cx + q * np.cos(t)), float(cy + q * np.sin(t))) for q, t in zip(r, a)]
        if k % 3 == 0:
            rng.shuffle(outer)  # crosses itself
        hole = [(float(cx + 20 * np.cos(t)), float(cy + 20 * np.sin(t))) for t in a]
        shapes.append((k, "c", [outer if k % 2 else outer + outer[:1], hole, box(cx + 400, cy)[0]], "32632", None))
    pts = [(k, "c", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-100, 2400, (1500, 2)))] + [(9001, "c", None, 1.0), (9002, None, 10.0, 10.0)]
    p = spark.createDataFrame(pts, "pixel_id bigint, cube_name string, x double, y double")
    want = {(k, s[0]) for k, c, x, y in pts if c and x is not None for s in shapes if inside(x, y, s[2])}
    for hot in (100_000, 5):
        got = {(r.pixel_id, r.region_id) for r in containing_regions(p, spark.createDataFrame(shapes, ANN), ["cube_name"], "pixel_id", "id", hot_rows=hot).collect()}
        assert got == want


def test_borders_are_half_open(spark):
    a = spark.createDataFrame([(1, "c", box(0, 0), "", None), (2, "c", box(10, 0), "", None)], ANN)
    p = spark.createDataFrame([(1, "c", 5.0, 0.0), (2, "c", -5.0, -5.0), (3, "c", 0.0, 5.0)], "pixel_id bigint, cube_name string, x double, y double")
    assert sorted((r.pixel_id, r.region_id) for r in containing_regions(p, a, ["cube_name"], "pixel_id", "id").collect()) == [(1, 2), (2, 1)]


def test_a_region_of_many_vertices_is_one_row_a_cell_and_a_point_meets_few(spark):
    n = 10_000
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 300 + 40 * np.sin(37 * t)
    ring = [(float(500 + q * np.cos(a)), float(500 + q * np.sin(a))) for q, a in zip(r, t)]
    a = spark.createDataFrame([(1, "c", [ring], "", None), (2, "c", box(510, 510, 3.0), "", None)], ANN)
    rows = proximity.trapezoids(a, ["cube_name", "id"]).groupBy("id").count().collect()
    assert all(x["count"] <= 9 for x in rows)
    rng = np.random.default_rng(1)
    pts = [(k, "c", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(100, 900, (400, 2)))] + [(k + 400, "c", ring[k * 31][0] + 1e-3, ring[k * 31][1]) for k in range(300)]
    p = spark.createDataFrame(pts, "pixel_id bigint, cube_name string, x double, y double")
    got = {(q.pixel_id, q.region_id) for q in containing_regions(p, a, ["cube_name"], "pixel_id", "id").collect()}
    assert got == {(k, i) for k, _, x, y in pts for i, shape in ((1, [ring]), (2, box(510, 510, 3.0))) if inside(x, y, shape)}
