import numpy as np
from pyspark.sql import functions as F

from chronoraster.operators.regular_grid import observed_periods, regular_grid, seasonal_fit

SCHEMA = "id bigint, obs_time timestamp, ndvi double, model string"
P = 16 * 86400


def test_gaps_are_filled_between_observed_ends_only(spark, at):
    df = spark.createDataFrame([(1, at(3 * P + 5), 0.4, "m"), (1, at(3 * P + 9), 0.6, "m"), (1, at(6 * P), 0.8, "m"), (2, at(P), 0.1, "m")], SCHEMA)
    got = sorted((r.id, r.period_no, r.n_readings, r.source) for r in regular_grid(df).collect())
    assert got == [(1, 3, 2, "observed"), (1, 4, 0, "filled"), (1, 5, 0, "filled"), (1, 6, 1, "observed"), (2, 1, 1, "observed")]
    v = {(r.id, r.period_no): r for r in regular_grid(df).collect()}
    assert v[1, 3].value == 0.5 and v[1, 6].value == 0.8
    assert 0.4 < v[1, 4].value < v[1, 5].value < 0.9
    assert v[1, 4].period_start == at(4 * P)


def test_period_starts_are_included_and_times_before_the_start_count_down(spark, at):
    df = spark.createDataFrame([(1, at(0), 0.4, ""), (1, at(-1), 0.6, "")], SCHEMA)
    assert sorted(r.period_no for r in regular_grid(df).collect()) == [-1, 0]


def test_missing_and_impossible_readings_are_no_readings(spark, at):
    df = spark.createDataFrame([(1, at(0), 0.4, ""), (1, at(P), -9999.0, ""), (1, at(2 * P), float("nan"), ""), (1, at(3 * P), 1.5, ""), (1, at(4 * P), 0.4, ""), (None, at(0), 0.3, ""), (3, None, 0.3, ""), (4, at(0), None, "")], SCHEMA)
    got = sorted((r.id, r.period_no, r.source) for r in regular_grid(df).collect())
    assert got == [(1, 0, "observed"), (1, 1, "filled"), (1, 2, "filled"), (1, 3, "filled"), (1, 4, "observed")]


def test_repeated_delivery_has_no_extra_weight(spark, at):
    df = spark.createDataFrame([(1, at(0), 0.2, "")] * 5 + [(1, at(40), 0.2, ""), (1, at(86400), 0.6, "")], SCHEMA)
    r = regular_grid(df).first()
    assert (r.n_readings, r.value) == (2, 0.4)


def test_empty(spark):
    assert regular_grid(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fit_equals_dense_ridge_regression(spark, at):
    rng = np.random.default_rng(1)
    t = np.sort(rng.choice(800, 60, replace=False)) * 86400
    v = np.clip(0.5 + 0.2 * np.sin(2 * np.pi * t / 86400 / 365.25) + rng.normal(0, 0.02, 60), -1, 1)
    obs = observed_periods(spark.createDataFrame([(1, at(int(a)), float(b), "") for a, b in zip(t, v)], SCHEMA)).toPandas()
    beta = np.array(seasonal_fit(spark.createDataFrame(obs)).first().beta)
    y = obs["years"].to_numpy()
    x = np.column_stack([np.ones_like(y), y, *[f(2 * np.pi * k * y) for k in (1, 2) for f in (np.cos, np.sin)]])
    want = np.linalg.solve(x.T @ x + np.diag([0, *[0.05] * 5]), x.T @ obs["value"].to_numpy())
    assert np.allclose(beta, want)


def test_held_out_periods_beat_the_mean(spark):
    s = spark.read.parquet("/root/testdata/sf0.001/ndvi_series.parquet")
    whole = regular_grid(s).filter("source = 'observed'").select("id", "period_no", F.col("value").alias("true"))
    period = F.floor((F.unix_seconds(F.col("obs_time").cast("timestamp")) - 1514764800) / P)
    part = regular_grid(s.filter(period % 5 != 2)).filter("source = 'filled'")
    both = part.join(whole, ["id", "period_no"])
    mean = whole.groupBy("id").agg(F.avg("true").alias("m"))
    err, base = both.join(mean, "id").agg(F.avg(F.abs(F.col("value") - F.col("true"))), F.avg(F.abs(F.col("m") - F.col("true")))).first()
    assert err < 0.8 * base
