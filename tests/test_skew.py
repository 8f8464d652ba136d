import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoraster import skew
from chronoraster.skew import bucketed_rank, exact_median, hot_keys, salted_join, split_series


def test_hot_keys_are_those_above_the_budget_whatever_the_size_of_the_table(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 1).when(F.col("id") < 500, None).otherwise(F.col("id")).alias("k"))
    for copies in (1, 7):
        many = df.crossJoin(spark.range(copies)).select("k")
        assert sorted(r["_n"] for r in hot_keys(many, F.xxhash64("k"), 50).collect()) == [100 * copies, 400 * copies]
    assert hot_keys(df, F.xxhash64("k"), 5000) is None


@pytest.mark.parametrize("listed", [20_000, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, monkeypatch, listed, how):
    monkeypatch.setattr(skew, "LISTED", listed)  # the longer list is a table
    big = spark.range(3000).select(F.col("id").alias("row"), (F.col("id") % 7).alias("k")).withColumn("k", F.when(F.col("row") < 2000, 0).when(F.col("row") < 2400, 1).when(F.col("row") < 2600, None).otherwise(F.col("k")))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    rows = lambda df: sorted(map(str, df.select("row", "k", "v").collect()))
    assert rows(salted_join(big, small, ["k"], F.col("row"), budget=100, how=how)) == rows(big.join(small, "k", how))


def test_a_key_gets_as_many_salts_as_it_needs(spark):
    big = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("row"))
    met = salted_join(big, spark.range(3).select(F.col("id").alias("k")), ["k"], F.col("row"), budget=10)
    assert "_salt" in met._jdf.queryExecution().analyzed().toString() and met.count() == 4000


def test_median_without_gathering_equals_the_median(spark):
    rng = np.random.default_rng(0)
    data = [(g, float(v)) for g, n in ((1, 501), (2, 400), (3, 1)) for v in np.r_[rng.normal(size=n // 2), np.zeros(n - n // 2)]]
    got = {r.g: r["median"] for r in exact_median(spark.createDataFrame(data, "g int, v double"), ["g"], "v", bins=7).collect()}
    assert got == {g: float(np.median([v for k, v in data if k == g])) for g in (1, 2, 3)}


def test_bucketed_rank_is_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), F.lit(1).alias("_rn"))
    got = bucketed_rank(df, ["g"], F.substring("h", 1, 2), [F.col("h")], "rank").collect()
    for g in range(3):
        hs = sorted(r.h for r in got if r.g == g)
        assert all(hs[r["rank"] - 1] == r.h for r in got if r.g == g)


def test_split_series_covers_rows_once_and_adds_neighbours(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("k"), F.col("id").alias("t"))
    s = split_series(df, "k", "t", 5, hot_rows=200)
    own = s.filter("not _halo")
    assert own.count() == 1000 and own.select("t").distinct().count() == 1000
    parts = own.filter("k = 1").groupBy("_part").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_part").collect()
    assert len(parts) > 3 and [p._part for p in parts] == list(range(len(parts)))
    halo = {(r._part, r.t) for r in s.filter("_halo").collect()}
    for p in parts[1:-1]:
        assert {t for q, t in halo if q == p._part} == {*range(p.a - 5, p.a), *range(p.b + 1, p.b + 6)}


def test_halo_rows_of_tied_times_are_the_nearest_by_the_tie(spark):
    # the ties are larger than the halo, and the rows come in an order that is not theirs
    df = spark.range(2000).select(F.lit(1).alias("k"), F.pmod(F.col("id") * 977, F.lit(2000)).alias("r")).withColumn("t", F.floor(F.col("r") / 40))
    s = split_series(df, "k", "t", 5, hot_rows=400, tie="r")
    parts = s.filter("not _halo").groupBy("_part").agg(F.min("r").alias("a"), F.max("r").alias("b")).orderBy("_part").collect()
    halo = {(x._part, x.r) for x in s.filter("_halo").collect()}
    assert len(parts) > 3
    for p in parts[1:-1]:
        assert {r for q, r in halo if q == p._part} == {*range(p.a - 5, p.a), *range(p.b + 1, p.b + 6)}
