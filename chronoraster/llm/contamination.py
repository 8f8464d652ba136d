"""Evaluation passages inside training texts.

Runs of five words of the test items are looked up in every document; a hit yields the stretch of
the document around it. Every run of an item is a seed, so every stretch that shares a run with an
item is aligned with it by Smith and Waterman's method, which scores edited copies, and the longest
common run is taken. Pairs advance together in blocks, one word of the items a step, and only the
last row of each table is held, so memory does not grow with item times text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from ..skew import salted_join, tasks
from .words import WordHashes, run_hashes, words

GRAM = 5
FILTER_HASHES = 3
#: Runs of one pass over the texts; more are looked up in further passes, so the filter is at most 8 MB.
MAX_RUNS = 1 << 22
#: A matched word counts one in the low bits of an alignment's value, its score the high ones.
SCORE = 1 << 20


def filter_bits(runs: int) -> int:
    """log2 of the filter's size: 16 bits a run, 2^16 at least."""
    return max(16, (16 * max(1, runs) - 1).bit_length())


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """FILTER_HASHES positions in the filter for each hash."""
    with np.errstate(over="ignore"):
        mixed = [h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k & (1 << 64) - 1) for k in range(FILTER_HASHES)]
    return np.stack([u >> np.uint64(64 - bits) for u in mixed]).astype(np.int64)


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words, grams (hashes of runs of five words), one row per item; rows without key left out."""

    def split(batches):
        hashes = WordHashes()
        for pdf in batches:
            ws = [words(t) for t in pdf["t"]]
            yield pd.DataFrame({"item_id": pdf["k"], "words": ws, "grams": [run_hashes(hashes(w), GRAM) for w in ws]})

    kind = dict(items.dtypes)[key]
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    return rows.mapInPandas(split, f"item_id {kind}, words array<string>, grams array<bigint>")


def gram_filter(grams: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the column ``h`` (distinct) with 2^bits bits.

    What comes to the driver are the bytes that are set; false hits are removed by the join.
    """

    def slots(batches):
        for pdf in batches:
            yield pd.DataFrame({"slot": np.unique(_slots(pdf["h"].to_numpy(np.int64), bits))})

    set_ = grams.select("h").mapInPandas(slots, "slot bigint")
    got = set_.groupBy(F.floor(F.col("slot") / 8).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(pmod(slot, 8) as int)))").alias("set")).toPandas()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[got["byte"].to_numpy(np.int64)] = got["set"].to_numpy(np.uint8)
    return out


def stretches(docs: DataFrame, table: np.ndarray, margin: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """seg, doc_id, words, hits: the parts of documents around runs that pass the filter.

    One pass over the whole texts. A part reaches ``margin`` words to either side of its hits;
    overlapping parts are one. ``seg`` is a hash of key, place and words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)
    bits_of = len(table).bit_length() + 2

    def find(batches):
        import xxhash

        hashes, bits = WordHashes(), sent.value
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                ws = words(t)
                h = run_hashes(hashes(ws), GRAM)
                if not len(h):
                    continue
                ok = np.ones(len(h), bool)
                for s in _slots(h, bits_of):
                    ok &= (bits[s >> 3] >> (s & 7)) & 1 == 1
                hit = np.flatnonzero(ok)
                if not len(hit):
                    continue
                for part in np.split(hit, np.flatnonzero(np.diff(hit) > 2 * margin + GRAM) + 1):
                    a, b = max(0, int(part[0]) - margin), min(len(ws), int(part[-1]) + GRAM + margin)
                    text_of = " ".join(ws[a:b])
                    out.append((xxhash.xxh64_intdigest(f"{k}|{a}|{text_of}") - (1 << 63), k, text_of, np.unique(h[part])))
            yield pd.DataFrame(out, columns=["seg", "doc_id", "words", "hits"]).astype({"doc_id": pdf["k"].dtype})

    kind = dict(docs.dtypes)[key]
    found = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(find, f"seg bigint, doc_id {kind}, words string, hits array<bigint>")
    return found.dropDuplicates(["seg", "doc_id", "words"])  # texts whose hashes are equal both stay


def _blocks(items: list[str], texts: list[str], cells: int):
    """Blocks of pairs of like length: their numbers, words of items (m, pairs) and of texts (n, pairs)."""
    ids: dict[str, int] = {}
    known: dict[str, np.ndarray] = {}

    def coded(t: str) -> np.ndarray:
        if t not in known:
            known[t] = np.array([ids.setdefault(w, len(ids)) for w in t.split()], np.int32)
        return known[t]

    xs, ys = [coded(t) for t in items], [coded(t) for t in texts]
    nx, ny = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    order, at = np.lexsort((nx, ny))[::-1], 0
    while at < len(order):
        n = int(ny[order[at]])
        block = order[at : at + max(1, cells // (n + 1))]
        at += len(block)
        x, y = np.full((int(nx[block].max()), len(block)), -1, np.int32), np.full((n, len(block)), -2, np.int32)
        for k, i in enumerate(block):
            x[: nx[i], k], y[: ny[i], k] = xs[i], ys[i]
        yield block, x, y


def best_scores(items: list[str], texts: list[str], match: int = 2, miss: int = -1, gap: int = -1, cells: int = 1 << 16) -> np.ndarray:
    """Best local alignment score of each pair of texts (words between spaces).

    Pairs of like length advance together, one word of the items a step, in blocks of at most
    ``cells`` cells (a pair at least).
    """
    out = np.zeros(len(items), np.int64)
    for block, x, y in _blocks(items, texts, cells):
        (m, _), (n, _) = x.shape, y.shape
        kind = np.int16 if (match + 1) * (m + n + 1) < 1 << 15 else np.int32
        ramp = (np.arange(n + 1) * gap).astype(kind)[:, None]
        row, best = np.zeros((n + 1, len(block)), kind), np.zeros(len(block), kind)
        for w in x:
            new = np.zeros_like(row)
            np.maximum(row[:-1] + np.where(y == w, kind(match), kind(miss)), row[1:] + kind(gap), out=new[1:])
            np.maximum(new, 0, out=new)
            new -= ramp
            np.maximum.accumulate(new, axis=0, out=new)
            new += ramp
            np.maximum(best, new.max(axis=0), out=best)
            row = new
        out[block] = best
    return out


def alignments(items: list[str], texts: list[str], match: int = 2, miss: int = -1, gap: int = -1, cells: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair the best local alignment score, the most words it can match, the longest common run.

    Scores as in ``best_scores``. The matched words are carried along in the low bits of the values
    and the run of each place beside them, so no table is kept to trace back.
    """
    score, matched, longest = (np.zeros(len(items), np.int64) for _ in range(3))
    for block, x, y in _blocks(items, texts, cells):
        n = len(y)
        ramp = (np.arange(n + 1) * (gap * SCORE))[:, None]
        row, best = np.zeros((n + 1, len(block)), np.int64), np.zeros(len(block), np.int64)
        run, most = np.zeros((n + 1, len(block)), np.int32), np.zeros(len(block), np.int32)
        for w in x:
            same = y == w
            new = np.zeros_like(row)
            np.maximum(row[:-1] + np.where(same, match * SCORE + 1, miss * SCORE), row[1:] + gap * SCORE, out=new[1:])
            new[new < SCORE] = 0
            new -= ramp
            np.maximum.accumulate(new, axis=0, out=new)
            new += ramp
            new[new < SCORE] = 0  # an alignment without score holds nothing
            np.maximum(best, new.max(axis=0), out=best)
            row = new
            run[1:] = np.where(same, run[:-1] + 1, 0)
            np.maximum(most, run.max(axis=0), out=most)
        score[block], matched[block], longest[block] = best // SCORE, best % SCORE, most
    return score, matched, longest


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Best local alignment score of one pair, words it matches, longest common run."""
    return tuple(int(v[0]) for v in alignments([" ".join(a)], [" ".join(b)]))


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_run: int = 12, min_score: int | None = None) -> DataFrame:
    """item_id, doc_id, score, matched_share, longest_run: each document and the items it holds.

    ``score`` is the best local alignment (2 a match, -1 a mismatch or gap) over the stretches of
    the document, ``matched_share`` the share of the item's words in it, ``longest_run`` the
    longest run of words they have in common. Pairs below ``min_score`` (default: the score of a
    run of ``min_run`` words) are left out, so every pair with such a run is found, and every edited
    copy that reaches the score and keeps a run of five words, whatever other copies exist. Texts that are
    null, empty or without words match nothing; items below five words cannot seed. Rows without
    key are passed over; repeated rows give a pair once. Other columns do not matter.
    """
    min_score = 2 * min_run if min_score is None else min_score
    tests = keep(item_words(items.select(item_key, text), item_key, text), "items")
    seeds = keep(tests.select("item_id", F.explode("grams").alias("h")).distinct(), "seeds")
    grams = seeds.select("h").distinct()
    runs = grams.count()
    passes = max(1, -(-runs // MAX_RUNS))
    margin = tests.agg(F.max(F.size("words"))).first()[0] or 0
    each = []
    for k in range(passes):
        some = grams.filter(F.pmod(F.xxhash64("h"), F.lit(passes)) == k) if passes > 1 else grams
        each.append(stretches(docs.select(doc_key, text), gram_filter(some, filter_bits(-(-runs // passes))), margin, doc_key, text))
    found = keep(reduce(DataFrame.unionByName, each), "stretches")
    hits = found.select("seg", F.explode("hits").alias("h"))
    candidates = keep(salted_join(hits, seeds, ["h"], F.col("seg")).select("item_id", "seg").distinct(), "candidates")
    sides = salted_join(candidates, tests.select("item_id", F.array_join("words", " ").alias("item")), ["item_id"], F.col("seg"))
    pairs = sides.join(found.select("seg", "doc_id", "words"), "seg")

    def score(batches):
        for pdf in batches:
            pdf = pdf[best_scores(list(pdf["item"]), list(pdf["words"])) >= min_score]
            score, matched, longest = alignments(list(pdf["item"]), list(pdf["words"]))
            share = matched / np.maximum(1, pdf["item"].str.split().str.len().to_numpy(np.int64))
            yield pd.DataFrame({"item_id": pdf["item_id"], "doc_id": pdf["doc_id"], "score": score, "matched_share": share, "longest_run": longest})

    kinds = dict(pairs.dtypes)
    # aligning is far dearer than reading a pair, so pairs are dealt out evenly
    dealt = pairs.repartition(tasks(pairs), F.col("item_id"), F.col("seg"))
    each = dealt.mapInPandas(score, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score int, matched_share double, longest_run int").filter(F.col("score") >= min_score)
    best = each.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.max("matched_share").alias("matched_share"), F.max("longest_run").alias("longest_run"))
    return best.select(F.col("item_id").alias(item_key), F.col("doc_id").alias(doc_key), "score", "matched_share", "longest_run")
