import itertools
import random
from collections import Counter

import pytest

from chronoraster.llm.splits import grouped_splits, linked_pairs, random_mate, shared_tile_edges, split_report

PX = "pixel_id bigint, cube_name string, tile_i int, tile_j int, mask smallint, id bigint, group_key string"


def components(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    out = {}
    for x in list(up):
        out.setdefault(root(x), set()).add(x)
    return {frozenset(c) for c in out.values() if len(c) > 1}


@pytest.mark.parametrize("n,m,seed", [(60, 40, 1), (200, 260, 2), (50, 0, 3)])
def test_components_equal_union_find(spark, n, m, seed):
    rng = random.Random(seed)
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    e += [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)]  # a chain and a star
    df = spark.createDataFrame([*e, *e[:5], (None, 1), (7, None)], "u bigint, v bigint")
    got = {}
    for r in random_mate(df).collect():
        got.setdefault(r.label, set()).add(r.vertex)
    assert {frozenset(c) for c in got.values()} == components(x for x in e if x[0] != x[1])


def test_no_edges(spark):
    e = spark.createDataFrame([(1, 1), (None, None)], "u bigint, v bigint")
    assert random_mate(e).count() == 0 and linked_pairs(random_mate(e)).count() == 0


def test_pairs_of_a_large_component_are_complete(spark):
    labels = spark.createDataFrame([(k, 0) for k in range(60)] + [(100, 100)], "vertex bigint, label bigint")
    want = set(itertools.combinations(range(60), 2))
    for hot in (2000, 10):
        assert {(r.id_a, r.id_b) for r in linked_pairs(labels, hot).collect()} == want


def pixels():
    rng = random.Random(5)
    out, k = [], 0
    for i in range(300):
        cube, ti = f"c{i % 7}", 64 * rng.randrange(40)
        for _ in range(rng.randrange(1, 12)):
            k += 1
            out.append((k, cube, ti + 64 * rng.randrange(2), 0, rng.choice([1, 1, 1, 0, 255, None]), rng.choice([i, i, i, None]), "clash"))
    return out


def shares(spark, rows=(("train", 0.8), ("validation", 0.1), ("test", 0.1))):
    return spark.createDataFrame(list(rows), "split_name string, share double")


def test_nothing_is_torn_apart_and_shares_are_met(spark):
    data = pixels()
    got = grouped_splits(spark.createDataFrame(data, PX), shares(spark))
    split = {r.pixel_id: r.split_name for r in got.collect()}
    masked = [p for p in data if p[4] == 1]
    assert set(split) == {p[0] for p in masked}
    by_id, by_tile = {}, {}
    for p in masked:
        if p[5] is not None:
            by_id.setdefault(p[5], set()).add(split[p[0]])
        by_tile.setdefault(p[1:4], set()).add(split[p[0]])
    assert all(len(s) == 1 for s in [*by_id.values(), *by_tile.values()])
    n = Counter(split.values())
    assert abs(n["train"] / len(split) - 0.8) < 0.03 and abs(n["test"] / len(split) - 0.1) < 0.03
    rep = {r.split_name: r for r in split_report(got, shares(spark)).collect()}
    assert rep["train"].n_records == n["train"] and abs(sum(r.got_share for r in rep.values()) - 1) < 1e-9


def test_a_third_in_one_group_goes_to_the_largest_split(spark):
    data = [(k, "c", 0, 0, 1, 1, "") for k in range(300)] + [(1000 + k, "c", 64 * k, 64, 1, 10 + k, "") for k in range(600)]
    got = grouped_splits(spark.createDataFrame(data, PX), shares(spark)).collect()
    assert {r.split_name for r in got if r.id == 1} == {"train"}
    n = Counter(r.split_name for r in got)
    assert (n["train"], n["validation"], n["test"]) == (720, 90, 90)


def test_nulls_repeats_and_empty(spark):
    blank = (None,) * 7
    data = [blank, (1, None, None, None, 1, None, ""), (1, None, None, None, 1, None, ""), (2, "c", 0, 0, 1, None, ""), (3, "c", None, 0, 1, 5, ""), (None, "c", 0, 0, 1, 6, "")]
    got = grouped_splits(spark.createDataFrame(data, PX), shares(spark)).collect()
    assert len(got) == 5
    assert len({r.split_name for r in got if r.id == 6 or r.pixel_id == 2}) == 1  # the bare pixel follows its tile
    assert grouped_splits(spark.createDataFrame([], PX), shares(spark)).count() == 0
    with pytest.raises(ValueError):
        grouped_splits(spark.createDataFrame(data, PX), shares(spark, [("x", 0.0), (None, 1.0)]))


def test_tile_edges_are_fewer_than_pairs(spark):
    df = spark.createDataFrame([(k, "c", 0, 0, 1, k, "") for k in range(50)], PX)
    assert shared_tile_edges(df, "id", ["cube_name", "tile_i", "tile_j"]).count() == 49
