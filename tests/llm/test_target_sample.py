from collections import Counter

from chronoraster.llm.target_sample import label_key, target_report, target_sample

ITEMS = "cube_name string, i int, j int, cls string, share string"
TARGETS = "cube_name string, cls string, target_share double, min_keep int, sample_size int"
SPELLINGS = ["No-Annotation", "no annotation", "NO_ANNOTATION ", "No-annotation\t"]


def items(spark, a, n, cube="c"):
    rows = [(cube, k, 0, ["Annotation", "ANNOTATION "][k % 2], "") for k in range(a)] + [(cube, k, 64, SPELLINGS[k % 4], "") for k in range(n)]
    return spark.createDataFrame(rows + rows[:3] + [(cube, 999, 999, None, ""), (None, 1, 1, "Annotation", ""), (cube, None, 1, "Annotation", ""), (cube, 5, 5, " - ", "")], ITEMS)


def targets(spark, share=0.25, keep=(2, 2), size=20, cube="c"):
    return spark.createDataFrame([(cube, "Annotation", share, keep[0], size), (cube, "No-Annotation", 1 - share, keep[1], size)], TARGETS)


def drawn(df):
    rows = df.collect()
    assert len({(r.cube_name, r.cls, r.i, r.j) for r in rows}) == len(rows)
    return Counter(r.cls for r in rows)


def test_shares_are_met(spark):
    assert drawn(target_sample(items(spark, 40, 60), targets(spark))) == {"Annotation": 5, "No-Annotation": 15}


def test_seats_of_an_exhausted_category_pass_on(spark):
    t = targets(spark, 0.8)
    assert drawn(target_sample(items(spark, 6, 60), t)) == {"Annotation": 6, "No-Annotation": 14}
    rep = {r.cls: r for r in target_report(items(spark, 6, 60), t).collect()}
    assert (rep["Annotation"].wanted, rep["Annotation"].available, rep["Annotation"].drawn, rep["Annotation"].short) == (16.0, 6, 6, True)
    assert not rep["No-Annotation"].short


def test_minimum_before_share(spark):
    assert drawn(target_sample(items(spark, 40, 60), targets(spark, 0.05, (4, 1)))) == {"Annotation": 4, "No-Annotation": 16}
    assert drawn(target_sample(items(spark, 40, 60), targets(spark, 0.0, (3, 1)))) == {"Annotation": 3, "No-Annotation": 17}
    assert sum(drawn(target_sample(items(spark, 40, 60), targets(spark, 0.5, (30, 30)))).values()) == 20


def test_exactly_as_many_as_wanted_is_not_short(spark):
    t = targets(spark, 0.07, (0, 0), 100)  # 0.07 x 100 is a little above 7 in binary
    assert {r.cls: r.short for r in target_report(items(spark, 7, 93), t).collect()} == {"Annotation": False, "No-Annotation": False}


def test_everything_is_taken_from_a_small_group(spark):
    assert drawn(target_sample(items(spark, 3, 4), targets(spark, size=50))) == {"Annotation": 3, "No-Annotation": 4}


def test_sample_is_a_divisor_apportionment(spark):
    for share in (0.1, 0.37, 0.5, 0.9):
        got = drawn(target_sample(items(spark, 100, 100), targets(spark, share, (0, 0), 33)))
        seats = {"Annotation": 0, "No-Annotation": 0}
        for _ in range(33):
            best = min(seats, key=lambda c: ((seats[c] + 0.5) / (share if c == "Annotation" else 1 - share), c))
            seats[best] += 1
        assert got == {k: v for k, v in seats.items() if v}


def test_same_seed_same_sample_and_other_seed_other(spark):
    a, b, c = (sorted(map(tuple, target_sample(items(spark, 40, 60), targets(spark), seed=s).collect())) for s in (1, 1, 2))
    assert a == b != c


def test_null_targets_and_empty_tables(spark):
    odd = spark.createDataFrame([("c", None, 0.5, 1, 4), (None, "Annotation", 0.5, 1, 4), ("c", "Annotation", None, None, None), ("c", "annotation", float("nan"), 1, 2)], TARGETS)
    assert drawn(target_sample(items(spark, 5, 5), odd)) == {"Annotation": 1}
    empty = spark.createDataFrame([], ITEMS)
    assert target_sample(empty, targets(spark)).count() == 0
    assert [r.short for r in target_report(empty, targets(spark)).collect()] == [True, True]
    assert target_sample(items(spark, 5, 5), spark.createDataFrame([], TARGETS)).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(s,) for s in [*SPELLINGS, "", " ", None]], "s string")
    assert [r[0] for r in df.select(label_key("s")).collect()] == ["noannotation"] * 4 + [None] * 3
