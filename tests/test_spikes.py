import numpy as np

from chronoraster.operators.spikes import ChartSpec, limit_flags, spike_flags

SCHEMA = "rec_id bigint, id bigint, obs_time timestamp, ndvi double, ndvi_undist double, part string"
DAY = 86400


def flags(df, spec=None):
    return {(r.field, r.row_key, "impossible" if r.impossible else "stuck" if r.stuck else "spike") for r in spike_flags(df, spec=spec).filter("impossible or stuck or spike").collect()}


def brute(data, lo=-1.0, hi=1.0):
    out = set()
    for col, f in ((3, "ndvi"), (4, "ndvi_undist")):
        ok = lambda v: v is not None and v == v and v not in (-9999, 99, 255) and lo <= v <= hi
        for r in data:
            v = r[col]
            if v is not None and v == v and v not in (-9999, 99, 255) and not ok(v):
                out.add((f, r[0], "impossible"))
        for i in {r[1] for r in data if r[1] is not None}:
            rows = sorted((r for r in data if r[1] == i and r[2] is not None), key=lambda r: (r[2], r[0]))
            sessions, last = [], None
            for r in rows:
                if last is None or (r[2] - last).total_seconds() >= 60:
                    sessions.append([])
                sessions[-1].append(r)
                last = r[2]
            use = [[r for r in s if ok(r[col])] for s in sessions]
            use = [s for s in use if s]
            v = [s[0][col] for s in use]
            mas = np.median(np.abs(np.diff(v))) if len(v) > 1 else np.nan
            for k in range(len(v)):
                stuck = any(0 <= a and a + 6 <= len(v) and max(v[a : a + 6]) - min(v[a : a + 6]) <= 0.0003 + 1e-9 for a in range(k - 5, k + 1))
                spike = 2 <= k < len(v) - 2 and abs(v[k] - np.median(v[k - 2 : k + 3])) > 6 * mas + 1e-9
                if stuck or spike:
                    out |= {(f, r[0], "stuck" if stuck else "spike") for r in use[k]}
    return out


def sample(at, ids=6, n=80, seed=2):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for i in range(ids):
        t = 0
        for j in range(n):
            t += int(rng.integers(1, 9)) * DAY
            v = round(float(0.5 + 0.2 * np.sin(j / 9) + rng.normal(0, 0.01)), 4)
            if rng.random() < 0.05:
                v = round(v - 0.4, 4)
            if 30 <= j < 38 and i % 2:
                v = 0.4321
            u = None if rng.random() < 0.1 else round(v + 0.05, 4)
            v = float(rng.choice([-9999.0, np.nan, 1.7, -3.0])) if rng.random() < 0.08 else v
            for copy in range(2 if rng.random() < 0.1 else 1):
                k += 1
                out.append((k, i, at(t + 35 * copy), v, u, "p"))
    return out


def test_flags_equal_the_definitions(spark, at):
    data = sample(at)
    assert flags(spark.createDataFrame(data, SCHEMA)) == brute(data)


def whole(df, spec):
    return {tuple(r) for r in spike_flags(df, spec=spec).collect()}


def test_hot_sources_in_parts_give_the_same_flags_and_numbers(spark, at):
    data = sample(at, 3, 400, 7) + [(10_000 + k, 9, at(k * DAY), 0.25 if k % 90 > 20 else 0.3 + 0.01 * (k % 7), None, "p") for k in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    rules = {"block": 32, "warm_up": 8}
    cold = whole(df, ChartSpec(**rules))
    assert {(f, k, "impossible" if i else "stuck" if s else "spike") for f, k, i, s, p, *_ in cold if i or s or p} == brute(data)
    for hot_rows in (350, 64):  # some sources hot, all of them hot
        assert whole(df, ChartSpec(hot_rows=hot_rows, **rules)) == cold
    assert any(r[7] and r[7] > 30 for r in cold) and sum(bool(r[5]) for r in cold) > 10


def test_a_hot_source_with_many_rows_a_reading_gives_the_same(spark, at):
    rng = np.random.default_rng(11)
    data = []
    for j in range(60):
        v = 0.4321 if 20 <= j < 34 else round(float(0.5 + 0.2 * np.sin(j / 4) + rng.normal(0, 0.01)) - (0.4 if j % 7 == 3 else 0), 4)
        for c in range(100):  # only the earliest row of a reading gives its value
            data.append((100 * j + c, 1, at(j * DAY + 0.3 * c), v if c == 0 else round(float(rng.uniform(0, 0.9)), 4), None if c < 70 else round(v + 0.05, 4), "p"))
    df = spark.createDataFrame(data, SCHEMA)
    assert flags(df, ChartSpec(hot_rows=400, block=16, warm_up=8)) == brute(data)
    assert whole(df, ChartSpec(hot_rows=400, block=16, warm_up=8)) == whole(df, ChartSpec(block=16, warm_up=8))


def test_chart_sees_a_spike_and_is_not_carried_away(spark, at):
    v = [0.5 + 0.005 * (k % 2) for k in range(40)]
    v[20] = 0.9
    df = spark.createDataFrame([(k, 1, at(k * DAY), x, None, "") for k, x in enumerate(v)], SCHEMA)
    got = {r.row_key: r for r in spike_flags(df).collect()}
    assert got[20].spike and got[20].chart_signal and got[20].chart_z > 4
    assert set(got) == {20}  # the clipped update leaves the readings after it unsuspected


def test_nulls_ties_repeats_and_empty(spark, at):
    data = [(1, None, at(0), 5.0, None, None), (2, 1, None, -7.0, 0.1, None), (None, 1, at(0), 0.2, 0.2, None), (3, 1, at(0), 0.2, None, None), (3, 1, at(0), 0.2, None, None), (None, None, None, None, None, None)]
    assert flags(spark.createDataFrame(data, SCHEMA)) == {("ndvi", 1, "impossible"), ("ndvi", 2, "impossible")}
    assert spike_flags(spark.createDataFrame([], SCHEMA)).count() == 0


def test_class_codes(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate([4, 0, 11, 12, -1, 99, 255, -9999, None, 400])], "pixel_id bigint, scl smallint")
    assert sorted(r.row_key for r in limit_flags(df, ["scl"], "pixel_id", 0, 11).collect()) == [3, 4, 9]
