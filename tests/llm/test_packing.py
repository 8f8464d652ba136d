from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoraster.llm.packing import difference_partition, encoder, fill_report, pack, packed, token_sizes

SPECS = [(1, 512), (2, 2048), (3, 8192)]


@given(st.lists(st.integers(0, 100), max_size=60))
@settings(max_examples=150, deadline=None)
def test_no_window_is_above_the_capacity_and_none_is_empty(sizes):
    s = np.array(sizes, np.int64)
    w = pack(s, 100)
    assert len(w) == len(s)
    if len(s):
        assert np.bincount(w, weights=s).max() <= 100 and set(w) == set(range(w.max() + 1))


def test_differencing_makes_near_equal_windows():
    s = np.random.default_rng(0).integers(1, 1000, 300)
    w = difference_partition(s, 7)
    load = np.bincount(w, weights=s, minlength=7)
    assert load.sum() == s.sum() and load.max() - load.min() < 20
    assert set(difference_partition(np.array([5, 3]), 4)) <= set(range(4))


def test_windows_are_nearly_full():
    rng = np.random.default_rng(1)
    for cap, s in ((512, rng.integers(1, 512, 1024)), (2048, np.minimum(2047, rng.lognormal(6.7, 0.6, 1024).astype(int))), (8192, np.minimum(8191, rng.lognormal(6.7, 0.8, 1024).astype(int)))):
        w = pack(s, cap)
        assert s.sum() / (cap * (w.max() + 1)) > 0.95


def specs(spark, rows=SPECS):
    return spark.createDataFrame(rows, "spec_id int, capacity_tokens int")


def check(rows, want, capacities):
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.spec_id, r.container] += r.n_tokens
        pieces[r.spec_id, r.doc_id, r.doc_tokens, r.copy_no].append(r)
    assert all(v <= capacities[s] for (s, _), v in load.items())
    for s, cap in capacities.items():
        got = defaultdict(list)
        for (k, d, whole, c), p in pieces.items():
            if k == s:
                p.sort(key=lambda r: r.piece_no)
                assert [r.piece_no for r in p] == list(range(len(p)))
                assert [r.token_start for r in p] == [cap * i for i in range(len(p))]
                n = sum(r.n_tokens for r in p)
                assert n == whole
                assert len(p) == max(1, -(-n // cap))  # cut only if above the capacity
                got[d].append(n)
        assert {d: sorted(v) for d, v in got.items()} == want


def test_every_item_is_packed_once(spark):
    rng = np.random.default_rng(3)
    data = [(k, int(n)) for k, n in enumerate(rng.lognormal(6.5, 1.2, 3000))] + [(5000, 512), (5001, 1024), (5002, 0), (5003, 0), (5004, 100_000)] + [(7, 33)] * 40 + [(None, 12), (None, 12)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint")
    want = defaultdict(list)
    for k, n in data:
        want[k].append(n)
    rows = packed(df, specs(spark), shard_items=256)
    check(rows.collect(), {k: sorted(v) for k, v in want.items()}, dict(SPECS))
    assert all(r.fill > 0.93 and r.largest <= r.capacity_tokens for r in fill_report(rows).collect())


def test_one_key_with_most_rows_and_empty_inputs(spark):
    df = spark.createDataFrame([(1, 7)] * 900, "doc_id bigint, n_tokens bigint")
    rows = packed(df, specs(spark, [(1, 70)]), shard_items=100)
    assert rows.groupBy("container").count().count() <= 100 and rows.count() == 900
    assert packed(df.limit(0), specs(spark)).count() == 0
    assert packed(df, specs(spark, [(1, 0), (2, None)])).count() == 0


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello"), (2, None), (3, ""), (4, " \n\t "), (5, "x " * 200_000), (6, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_sizes(docs).collect()}
    assert got[1] == 4 and got[2] == got[3] == 0 and got[4] > 0 and got[5] >= 200_000 and got[6] > 1
    enc = encoder()
    assert enc.decode(enc.encode_ordinary("ein Über-Text 123")) == "ein Über-Text 123"


def test_sizes_equal_the_same_vocabulary_in_another_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("A model's data aren't 12,345.6 km away\n\n  really", "\\section{Über} $x_1^2$ % note\r\n", "a" * 300):
        assert len(encoder().encode_ordinary(text)) == len(t.encode(text, add_special_tokens=False).ids)
