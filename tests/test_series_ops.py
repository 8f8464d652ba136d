import datetime as dt

import numpy as np
import pandas as pd
import pytest

from chronoraster.operators.changepoint import binary_segmentation, change_points
from chronoraster.operators.timeseries import best_date, despike, nearest_date, slope_changes, smoothed_difference


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_despike_by_hand_and_by_formula(spark):
    v = [0.8, 0.8, 0.79, 0.1, 0.8, 0.81, 0.8]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "id int, obs_time int, ndvi double")
    assert [r.ndvi_despiked for r in despike(df, "ndvi").orderBy("obs_time").collect()] == [0.8, 0.8, 0.79, 0.8, 0.8, 0.81, 0.8]
    rng = np.random.default_rng(0)
    s = pd.Series(np.round(rng.normal(0.5, 0.1, 300), 3))
    m = s.rolling(5, center=True, min_periods=1).median()
    d = (s - m).abs()
    z = 0.6745 * d / d.rolling(5, center=True, min_periods=1).median()
    want = s.where(~(z > 2), m)
    big = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(s)], "id int, obs_time int, ndvi double")
    for hot in (500_000, 60):
        assert np.allclose([r.ndvi_despiked for r in despike(big, "ndvi", hot_rows=hot).orderBy("obs_time").collect()], want)


def test_smoothed_difference(spark):
    df = spark.createDataFrame([(1, k, 0.1 * k, 1.0 if k else None) for k in range(6)], "id int, obs_time int, ndvi double, ndvi_undist double")
    want = 1.0 - pd.Series(np.arange(6) * 0.1).rolling(5, center=True, min_periods=1).mean()
    assert np.allclose([r.cdndvi for r in smoothed_difference(df).orderBy("obs_time").collect()], want)
    assert smoothed_difference(df.limit(0)).count() == 0


@pytest.mark.parametrize("back,ahead,mult,want", [(4, 3, 2.0, []), (6, 3, 2.0, [70]), (4, 3, 1.4, [70])])
def test_slope_changes(spark, back, ahead, mult, want):
    v = [0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.60, 0.80, 1.0, 1.2, 1.4, 1.6]
    df = spark.createDataFrame([(1, day(10 * k), float(x)) for k, x in enumerate(v)], "id int, date date, cdndvi double")
    for hot in (500_000, 5):
        assert [r.date for r in slope_changes(df, look_back=back, look_ahead=ahead, multiplier=mult, hot_rows=hot).collect()] == [day(n) for n in want]


def test_best_date(spark):
    s = "ann_id int, ord int, date date, confidence double"
    d = [day(0), day(40), day(81)]
    df = spark.createDataFrame([(1, k, x, c) for k, (x, c) in enumerate(zip(d, (0.2, 0.3, 0.9)))] + [(2, k, x, c) for k, (x, c) in enumerate(zip(d, (0.5, 0.6, 0.9)))] + [(3, 0, day(5), 0.0), (4, 0, None, 1.0)], s)
    assert {r.ann_id: r.best_date for r in best_date(df).collect()} == {1: dt.date(2020, 3, 22), 2: dt.date(2020, 1, 22), 3: None}


def test_nearest_date(spark):
    t = spark.createDataFrame([(1, "c", day(10)), (2, "c", None), (3, "x", day(1))], "id int, cube_name string, d date")
    s = spark.createDataFrame([("a", "c", day(8)), ("b", "c", day(12)), ("z", "c", day(30)), ("n", "c", None)], "scene_id string, cube_name string, scene_date date")
    assert {r.id: r.nearest_scene_id for r in nearest_date(t, s, ["cube_name"], "d", "scene_date", "scene_id").collect()} == {1: "a", 2: None, 3: None}


def test_change_points(spark):
    v = np.r_[np.zeros(20), np.ones(20), np.full(20, 3.0)]
    assert binary_segmentation(v, 1.0) == [20, 40]
    df = spark.createDataFrame([(1, day(k), float(x)) for k, x in enumerate(v)] + [(2, day(0), 1.0), (3, day(0), None)], "id int, date date, cdndvi double")
    assert sorted((r.id, r.date) for r in change_points(df).collect()) == [(1, day(19)), (1, day(39))]
