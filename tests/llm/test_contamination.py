import random

import pytest

from chronoraster.llm import contamination
from chronoraster.llm.contamination import align, alignments, best_scores, leaked_items
from chronoraster.llm.words import words

DOCS = "doc_id bigint, text string, words string"
ITEMS = "item_id bigint, text string, task string"
VOCAB = [f"w{k}" for k in range(400)]


def text(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def brute(docs, items, run=12):
    grams = lambda t: {tuple(w[k : k + run]) for w in [words(t)] for k in range(len(w) - run + 1)}
    d = [(k, grams(t)) for k, t, *_ in docs if k is not None]
    return {(i, k) for i, t, *_ in items if i is not None for k, g in d if grams(t) & g}


def found(spark, docs, items):
    rows = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return {(r.item_id, r.doc_id) for r in rows.filter("longest_run >= 12").collect()}


def test_words_of_markup():
    assert words(r"\section{Hot}% Cold $x_{12}$ a\\B \cite{ref7}, Äpfel-Mus") == ["hot", "cold", "x", "12", "a", "b", "ref7", "äpfel", "mus"]


def test_exactly_the_documents_with_a_run_of_twelve(spark):
    rng = random.Random(1)
    items = [(k, " ".join(text(rng, rng.choice([5, 11, 12, 40, 90]))), "t") for k in range(40)]
    stock = text(rng, 14)
    items += [(100 + k, " ".join([*stock, *text(rng, 20)]), "t") for k in range(5)]
    docs = []
    for k in range(150):
        body = text(rng, rng.choice([0, 3, 50, 400]))
        if k % 3 == 0:
            src = rng.choice(items)[1].split()
            n = rng.choice([11, 12, 13, 30])
            a = rng.randrange(max(1, len(src) - n + 1))
            part = src[a : a + n]
            part = [rng.choice(["{}", "\\emph{{{}}}", "{},\n%", "{}."]).format(w.upper() if rng.random() < 0.3 else w) for w in part]
            at = rng.randrange(len(body) + 1)
            body = body[:at] + part + body[at:]
        docs.append((k, " ".join(body), ""))
    docs += [(500, " ".join(stock), ""), (501, None, ""), (502, "", ""), (None, items[0][1], ""), docs[0]]
    items += [(None, docs[5][1], ""), (300, None, ""), (301, "", ""), items[3]]
    want = brute(docs, items)
    assert len(want) > 15 and found(spark, docs, items) == want


def test_edited_copy_is_aligned(spark):
    rng = random.Random(2)
    item = text(rng, 60)
    edited = [w if k % 9 else "changed" for k, w in enumerate(item)]  # no run of twelve is left
    rows = leaked_items(spark.createDataFrame([(1, " ".join([*text(rng, 300), *edited, *text(rng, 300)]), ""), (2, " ".join(text(rng, 600)), "")], DOCS), spark.createDataFrame([(9, " ".join(item), "")], ITEMS)).collect()
    assert [(r.item_id, r.doc_id) for r in rows] == [(9, 1)]
    assert rows[0].longest_run == 8 and rows[0].matched_share > 0.85


def test_an_edited_copy_beside_a_full_copy_is_found(spark):
    rng = random.Random(5)
    item = text(rng, 60)
    edited = [w if k % 10 != 9 else "changed" for k, w in enumerate(item)]  # the full copy holds the runs that the edits broke
    docs = [(1, " ".join([*text(rng, 100), *item, *text(rng, 100)]), ""), (2, " ".join([*text(rng, 100), *edited, *text(rng, 100)]), ""), (3, " ".join(text(rng, 300)), "")]
    rows = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(9, " ".join(item), "")], ITEMS)).collect()
    got = {r.doc_id: r for r in rows}
    assert set(got) == {1, 2} and got[1].longest_run == 60 and got[2].longest_run == 9
    assert got[2].matched_share >= 0.9 and got[2].score >= 2 * 54 - 6


def traced(a, b, match=2, miss=-1, gap=-1):
    """Score, most matched words of a best alignment, longest common run, cell by cell."""
    rows, best, longest = [[(0, 0)] * (len(b) + 1)], (0, 0), 0
    runs = [0] * (len(b) + 1)
    for x in a:
        row, new = [(0, 0)], [0]
        for j, y in enumerate(b, 1):
            s, m = rows[-1][j - 1]
            cell = max((s + (match if x == y else miss), m + (x == y)), (rows[-1][j][0] + gap, rows[-1][j][1]), (row[j - 1][0] + gap, row[j - 1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            new.append(runs[j - 1] + 1 if x == y else 0)
        rows.append(row)
        runs = new
        best, longest = max([best, *row]), max([longest, *new])
    return (*best, longest)


def test_alignments_of_many_pairs_are_those_of_one():
    rng = random.Random(6)
    pairs = [([rng.choice("abcdef") for _ in range(rng.choice([0, 1, 7, 30]))], [rng.choice("abcdefg") for _ in range(rng.choice([1, 9, 50]))]) for _ in range(60)]
    xs, ys = [" ".join(a) for a, _ in pairs], [" ".join(b) for _, b in pairs]
    want = [traced(a, b) for a, b in pairs]
    assert list(best_scores(xs, ys, cells=200)) == [w[0] for w in want]
    assert [tuple(map(int, v)) for v in zip(*alignments(xs, ys, cells=200))] == want


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2, 0.3])
def test_edited_copies_of_real_passages_are_recalled(spark, rate):
    """Words replaced, dropped or doubled at the rate given; recall of the copies is 0.9 at least."""
    rng = random.Random(int(rate * 100))
    items = [(r.item_id, r.text, "") for r in spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet").filter("text is not null").collect()]
    items = [x for x in items if len(words(x[1])) >= 30][:150]
    docs = []
    for k, (_, t, _) in enumerate(items):
        copy = []
        for w in words(t):
            edit = rng.choice(["replace", "drop", "double"]) if rng.random() < rate else ""
            copy += ["edited"] if edit == "replace" else [] if edit == "drop" else [w, w] if edit == "double" else [w]
        docs.append((k, " ".join([*text(rng, 60), *copy, *text(rng, 60)]), ""))
    got = {(r.item_id, r.doc_id) for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    recall = sum((i, k) in got for k, (i, *_) in enumerate(items)) / len(items)
    print(f"edit rate {rate}: recall {recall:.3f} of {len(items)}")
    assert recall >= 0.9


def test_more_runs_than_a_pass_takes_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(text(rng, 40)), "") for k in range(12)]
    docs = [(k, " ".join([*text(rng, 30), *items[k % 12][1].split()[k % 20 : k % 20 + 15], *text(rng, 30)]), "") for k in range(40)]
    want = found(spark, docs, items)
    monkeypatch.setattr(contamination, "MAX_RUNS", 100)
    assert found(spark, docs, items) == want == brute(docs, items) and len(want) >= 40


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c", "")], DOCS), spark.createDataFrame([(1, "a b c", "")], ITEMS)
    assert leaked_items(d.limit(0), i).count() == leaked_items(d, i.limit(0)).count() == leaked_items(d, i).count() == 0


def test_a_passage_in_a_third_of_the_documents_and_a_very_long_text(spark):
    rng = random.Random(3)
    p = " ".join(text(rng, 20))
    docs = [(k, f"{' '.join(text(rng, 10))} {p if k % 3 == 0 else ''}", "") for k in range(120)] + [(999, " ".join([*text(rng, 200_000), p]), "")]
    assert found(spark, docs, [(1, p, "")]) == {(1, k) for k in [*range(0, 120, 3), 999]}


def test_alignment_scores():
    assert align(list("abcde"), list("xxabcdeyy")) == (10, 5, 5)
    assert align(list("abcdefgh"), list("abcdXefgh")) == (15, 8, 4)
    assert align(list("abcd"), list("efgh")) == (0, 0, 0)
    assert align([], ["a"])[0] == 0
