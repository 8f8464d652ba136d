import math

from pyspark.sql import functions as F

from chronoraster.operators.fill import FillSpec, fill_missing, filled_cells, mine_dependencies

SCHEMA = "rec_id bigint, id bigint, cube_name string, obs_time timestamp, ndvi double, ndvi_undist double, scl smallint, extra string"
DAY = 86400


def rows(at):
    out = []
    k = 0
    for i in range(1, 6):
        for n in range(12):
            v = round(0.3 + 0.01 * n + 0.05 * i, 4)
            for copy in range(2):  # every reading is delivered twice, which makes (id, hour) a dependency
                k += 1
                out.append((k, i, "c", at(n * 5 * DAY + copy * 30), v, v + 0.1, 4, "x"))
    return out


def test_dependency_gives_the_very_value_and_groups_fill_the_rest(spark, at):
    data = rows(at)
    data[0] = (*data[0][:4], None, *data[0][5:])  # its twin knows
    data[10] = (*data[10][:4], -9999.0, *data[10][5:])  # neither of these two does
    data[11] = (*data[11][:4], float("nan"), *data[11][5:])
    df = spark.createDataFrame(data, SCHEMA)
    deps = mine_dependencies(df)
    assert {(d["determinant"], d["field"]) for d in deps if d["verified"] and d["field"] == "ndvi"} == {(("id", "_hour"), "ndvi")}
    got = {r.rec_id: r for r in fill_missing(df).collect()}
    assert len(got) == len(data)
    assert (got[1].ndvi, got[1].ndvi_source) == (data[1][4], "fd:id+hour")
    assert got[11].ndvi_source == got[12].ndvi_source == "group:id+span" and 0.3 < got[11].ndvi < 0.6
    assert got[2].ndvi_source == "observed" and got[2].extra == "x"


def test_a_dependency_on_a_column_of_the_table_is_mined_and_used(spark, at):
    schema = SCHEMA.replace("extra string", "scene_id string")
    # every scene is delivered again after five hours, so the hour does not lead to the other delivery
    data = [(2 * (12 * i + n) + c, i, "c", at(n * 5 * DAY + c * 5 * 3600), v := round(0.3 + 0.01 * n + 0.05 * i, 4), v + 0.1, 4, f"s{n}") for i in range(1, 6) for n in range(12) for c in range(2)]
    data[0] = (*data[0][:4], None, *data[0][5:])
    df = spark.createDataFrame(data, schema)
    deps = {d["determinant"]: d for d in mine_dependencies(df) if d["field"] == "ndvi"}
    assert {k for k, d in deps.items() if d["verified"]} == {("id", "scene_id")} and ("scene_id",) in deps
    got = {r.rec_id: r for r in fill_missing(df).collect()}
    assert (got[data[0][0]].ndvi, got[data[0][0]].ndvi_source) == (data[1][4], "fd:id+scene_id")


def test_values_beyond_the_limits_stay_and_are_no_donors(spark, at):
    df = spark.createDataFrame([(1, 1, "c", at(0), 7.5, 0.2, 4, None), (2, 1, "c", at(0), None, 0.2, 4, None)], SCHEMA)
    got = {r.rec_id: r for r in fill_missing(df).collect()}
    assert (got[1].ndvi, got[1].ndvi_source) == (7.5, "observed")
    assert got[2].ndvi is None and got[2].ndvi_source == "unfilled"


def test_nulls_in_all_columns_repeats_and_empty(spark, at):
    blank = (None,) * 8
    df = spark.createDataFrame([blank, blank, (3, 1, None, None, 0.5, None, 255, "y"), (3, 1, None, None, 0.5, None, 255, "y")], SCHEMA)
    got = fill_missing(df).collect()
    assert len(got) == 4
    assert all(r.ndvi == 0.5 for r in got)  # the mean of the table
    assert all(r.scl is None and r.scl_source == "unfilled" for r in got)
    assert fill_missing(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filled_cells_lists_exactly_the_missing(spark, at):
    data = rows(at)[:4] + [(99, 1, "c", at(5), 99.0, math.nan, None, "z")]
    df = spark.createDataFrame(data, SCHEMA)
    cells = {(r.field, r.rec_id) for r in filled_cells(fill_missing(df), "rec_id", ["ndvi", "ndvi_undist", "scl"]).collect()}
    assert cells == {("ndvi", 99), ("ndvi_undist", 99), ("scl", 99)}


def test_categorical_takes_the_most_frequent(spark, at):
    data = [(k, 1, "c", at(k * DAY), 0.5, 0.5, s, "") for k, s in enumerate([4, 4, 5, None])]
    got = {r.rec_id: r for r in fill_missing(spark.createDataFrame(data, SCHEMA), FillSpec(min_support=10**6)).collect()}
    assert (got[3].scl, got[3].scl_source) == (4, "group:id")


def test_held_out_values_are_estimated_well(spark):
    s = spark.read.parquet("/root/testdata/sf0.001/ndvi_series.parquet")
    usable = s.filter("ndvi between -1 and 1 and not isnan(ndvi)")
    hidden = s.withColumn("ndvi", F.when((F.col("rec_id") % 10 == 0), F.lit(None)).otherwise(F.col("ndvi")))
    back = fill_missing(hidden).filter("rec_id % 10 = 0").select("rec_id", F.col("ndvi").alias("guess")).join(usable.select("rec_id", "ndvi"), "rec_id")
    err, spread = back.agg(F.avg(F.abs(F.col("guess") - F.col("ndvi"))), F.stddev("ndvi")).first()
    assert err < 0.6 * spread


def test_several_dependencies_are_mined_and_what_they_imply_is_not(spark, at):
    # city -> ndvi, (kind, cube_name) -> scl; pairs with city are looked at only for what city does not determine
    schema = "rec_id bigint, id bigint, cube_name string, obs_time timestamp, ndvi double, ndvi_undist double, scl smallint, city string, kind string"
    data = [(n, n % 7, f"c{n % 4}", at(n * 3600 * 5), round((n % 10) / 10, 3), (n % 31) / 31, (n % 4 * 3 + n % 3) % 12, f"t{n % 10}", f"k{n % 3}") for n in range(600)]
    deps = mine_dependencies(spark.createDataFrame(data, schema))
    sure = {(d["determinant"], d["field"]) for d in deps if d["verified"]}
    assert {(("city",), "ndvi"), (("cube_name", "kind"), "scl")} <= sure
    by = {d["determinant"]: d["support"] for d in deps}
    assert by[("city",)] == 600 and by[("_hour",)] == 0 and not any("_hour" in k for k in by if len(k) == 2)


def test_hot_groups_are_filled_alike(spark, at, monkeypatch):
    from chronoraster.operators import fill

    data = rows(at) + [(1000 + k, 7, "hot", at(k * 40 * DAY), None if k % 3 else 0.5, 0.25, 4 if k % 2 else None, "x") for k in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted(map(str, fill_missing(df).collect()))
    monkeypatch.setattr(fill, "HOT_ROWS", 50)
    assert sorted(map(str, fill_missing(df).collect())) == want
    deps = mine_dependencies(df)
    assert sorted(map(str, fill_missing(df, dependencies=deps).collect())) == want
