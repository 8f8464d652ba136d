import random

import numpy as np
import pytest

from chronoraster.llm import repetition as repetition_module
from chronoraster.llm.repetition import _repeated, jensen_shannon, language_references, repetition
from chronoraster.llm.words import LETTERS, words

DOCS = "doc_id bigint, text string, lang string, n_words string"


def brute(ws, run=8):
    seen, mark = set(), [False] * len(ws)
    for k in range(len(ws) - run + 1):
        g = tuple(ws[k : k + run])
        if g in seen:
            mark[k : k + run] = [True] * run
        seen.add(g)
    return sum(mark)


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_repeated_words_equal_brute_force(run):
    rng = random.Random(run)
    for n in (0, 1, 7, 8, 9, 40, 300):
        for size in (1, 2, 3, 30):
            ws = [f"w{rng.randrange(size)}" for _ in range(n)]
            assert _repeated(ws, run) == (brute(ws, run) if n > run else 0)
    base = [f"x{k}" for k in range(100)]
    assert _repeated(base + base[20:50], 8) == 30 and _repeated(base, 8) == 0


def test_a_row_per_text_whatever_it_is(spark):
    s = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = [(1, f"\\emph{{{s}}}. {s.upper()}! 12 34", "en"), (2, s, "en"), (3, None, None), (4, "", "EN"), (5, " \n", "xx"), (None, s, ""), (2, s, "en"), (6, "word " * 300_000, "en"), (7, "1 2 3 4", "en")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS)
    rows = repetition(df, min_words=5).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    n = len(words(s, LETTERS))
    assert (got[1].n_words, got[1].repeated_words, got[1].repeated_share) == (2 * n, n, 0.5)
    assert got[2].repeated_share == got[3].repeated_share == got[4].repeated_share == got[7].repeated_share == 0.0
    assert got[6].repeated_share > 0.99
    assert got[3].class_distance is None and got[2].class_distance is not None and got[7].word_distance is None
    assert repetition(df.limit(0)).count() == 0


def test_references_are_over_all_texts(spark):
    df = spark.createDataFrame([(1, "aa aa bb", "EN", ""), (2, "aa cc", " en ", ""), (3, "zz", None, "")], DOCS)
    refs = {r.lang: r for r in language_references(df).collect()}
    assert dict(zip(refs["en"].what, refs["en"].shares)) == {"aa": 0.6, "bb": 0.2, "cc": 0.2} and refs["und"].what == ["zz"] and refs["und"].shares == [1.0]
    assert sum(refs["en"].classes) == pytest.approx(1.0)


def test_many_languages_have_references_of_their_own(spark, monkeypatch):
    rng = random.Random(4)
    data = [(k, " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(k % 9 if n % 3 else "") * 0 + "xyz"[k % 3] for n in range(60)), f"l{k % 9}", "") for k in range(60)]
    df = spark.createDataFrame(data, DOCS)
    rows = lambda: sorted(map(tuple, repetition(df).collect()))
    sent = rows()
    monkeypatch.setattr(repetition_module, "LISTED", 4)
    assert rows() == sent and len(language_references(df).collect()) == 9 and all(r[5] is not None for r in sent)


def test_divergence():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert jensen_shannon(p, p) == 0 and jensen_shannon(p, q) == 1
    assert 0 < jensen_shannon(np.array([0.5, 0.5]), p) < 1
