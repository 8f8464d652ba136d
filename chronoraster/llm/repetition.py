"""Repetition inside a document.

Two measures stand side by side. The share of words that lie in a run of eight words which also
starts earlier in the text is exact and decides. The divergence of a document's character classes
and common words from those of its language (Jensen-Shannon distance) shows broken and monotonous
text, too, but cannot tell a repeated sentence from a fresh one with the same words, and so cannot
give the share.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, keep
from ..skew import salted_join
from .words import LETTERS, words

CLASSES = ("lower", "upper", "digit", "space", "markup", "punctuation", "other")
COMMON = 200
#: Languages whose references are sent to every task (some kB each); more are joined to the texts.
LISTED = 256


def _repeated(ws: list[str], run: int) -> int:
    """Words that lie in a run of ``run`` words that also starts at an earlier word. Exact."""
    m = len(ws) - run + 1
    if m < 2:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
    # codes of ever longer runs: two equal codes stand for two equal runs
    have = 1
    while have < run:
        step = min(have, run - have)
        n = len(code) - step
        pair = code[:n] * (int(code.max()) + 1) + code[step : step + n]
        _, code = np.unique(pair, return_inverse=True)
        have += step
        if have < run and int(code.max()) + 1 == len(code):
            return 0  # no shorter run occurs twice, so no longer one does
    order = np.argsort(code, kind="stable")
    again = np.zeros(m, bool)
    s = code[order]
    again[order[1:]] = s[1:] == s[:-1]
    edge = np.zeros(len(ws) + 1, np.int64)
    at = np.flatnonzero(again)
    if not len(at):
        return 0
    edge[at] += 1
    edge[at + run] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


_KIND = np.full(256, CLASSES.index("punctuation"), np.uint8)
for _c in range(256):
    _ch = chr(_c)
    if _c >= 128:
        _KIND[_c] = CLASSES.index("other")
    elif _ch.islower():
        _KIND[_c] = CLASSES.index("lower")
    elif _ch.isupper():
        _KIND[_c] = CLASSES.index("upper")
    elif _ch.isdigit():
        _KIND[_c] = CLASSES.index("digit")
    elif _ch.isspace():
        _KIND[_c] = CLASSES.index("space")
    elif _ch in "\\{}$&%^_~#":
        _KIND[_c] = CLASSES.index("markup")


def _classes(text: str) -> np.ndarray:
    """Counts of character classes, by UTF-8 byte."""
    return np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=len(CLASSES))


def language(c: Column | str) -> Column:
    """Lower-case language code; ``und`` for null and blank."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t.isNull() | (t == ""), "und").otherwise(t)


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, classes, what, shares: per language the shares of the character classes, its 200 most
    common words and their shares, over all texts.

    Counts are combined per batch and again before the shuffle. Kept as a table, a row per language.
    """
    rows = docs.select(language(lang).alias("lang"), F.col(text).alias("t"))

    def count(batches):
        held: dict[str, tuple[np.ndarray, Counter]] = {}
        size = 0

        def out():
            rows = [(k, True, str(i), int(n)) for k, (cl, _) in held.items() for i, n in enumerate(cl)]
            rows += [(k, False, w, n) for k, (_, ws) in held.items() for w, n in ws.items()]
            return pd.DataFrame(rows, columns=["lang", "is_class", "what", "n"])

        for pdf in batches:
            for k, t in zip(pdf["lang"], pdf["t"]):
                if t:
                    cl, ws = held.get(k) or (np.zeros(len(CLASSES), np.int64), Counter())
                    size -= len(ws)
                    ws.update(words(t, LETTERS))
                    size += len(ws)
                    held[k] = (cl + _classes(t), ws)
            if size > 500_000:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    counts = rows.mapInPandas(count, "lang string, is_class boolean, what string, n bigint").groupBy("lang", "is_class", "what").agg(F.sum("n").alias("n"))
    counts = keep(counts, "words")  # read twice below; counting words is the dear part
    first = F.row_number().over(Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "what"))
    total = counts.groupBy("lang", "is_class").agg(F.sum("n").alias("total"))
    top = counts.withColumn("rn", first).filter(F.col("rn") <= COMMON).join(total, ["lang", "is_class"])
    share = F.struct(F.col("rn"), F.col("what"), F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"))
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, share)))
    both = top.groupBy("lang").agg(listed(F.col("is_class")).alias("c"), listed(~F.col("is_class")).alias("w"))
    classes = F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda i: F.coalesce(F.try_element_at(F.filter("c", lambda e: e["what"] == i.cast("string")), F.lit(1))["share"], F.lit(0.0)))
    out = keep(both.select("lang", classes.alias("classes"), F.transform("w", lambda e: e["what"]).alias("what"), F.transform("w", lambda e: e["share"]).alias("shares")), "references")
    drop_kept(counts)
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance (root of the divergence in bits) of two distributions; 0 to 1."""
    m = (p + q) / 2
    h = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return float(np.sqrt(max(0.0, (h(p) + h(q)) / 2)))


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", run: int = 8, min_words: int = 50, references: DataFrame | None = None) -> DataFrame:
    """key, n_words, repeated_words, repeated_share, class_distance, word_distance; a row per text.

    Words are runs of letters without case, command names left out. ``repeated_share`` is 0 for
    texts of fewer than ``run`` + 1 words, among them null and empty ones. The distances to the
    language's references are null below ``min_words`` words, as small samples always diverge.
    Repeated rows and null keys stay. ``lang`` None leaves the distances out. ``references`` are
    those of ``language_references``, taken from ``docs`` if not given; the numbers are the same
    whether the references are sent to the tasks or, with many languages, joined to the texts.
    """
    if lang is not None and references is None:
        references = language_references(docs, text, lang)
    sent = references.limit(LISTED + 1).collect() if references is not None else []
    joined = len(sent) > LISTED

    def known(classes, what, shares):
        own = np.asarray(shares, float)
        return np.asarray(classes, float), {w: i for i, w in enumerate(what)}, np.r_[own, max(0.0, 1 - own.sum())]

    listed = {} if joined else {r["lang"]: (r["classes"], r["what"], r["shares"]) for r in sent}

    def measure(batches):
        refs = {k: known(*v) for k, v in listed.items()}
        for pdf in batches:
            out = []
            for i, (t, la) in enumerate(zip(pdf["t"], pdf["la"])):
                ws = words(t, LETTERS)
                rep = _repeated(ws, run)
                cd = wd = None
                if joined and la not in refs and pdf["classes"].iloc[i] is not None:
                    if len(refs) >= LISTED:
                        refs.clear()
                    refs[la] = known(pdf["classes"].iloc[i], pdf["what"].iloc[i], pdf["shares"].iloc[i])
                ref = refs.get(la)
                if ref is not None and len(ws) >= min_words:
                    cl = _classes(t)
                    cd = jensen_shannon(cl / cl.sum(), ref[0])
                    n = np.bincount(np.fromiter((ref[1].get(w, len(ref[1])) for w in ws), np.int64, len(ws)), minlength=len(ref[1]) + 1)
                    wd = jensen_shannon(n / n.sum(), ref[2])
                out.append((len(ws), rep, rep / len(ws) if ws else 0.0, cd, wd))
            got = pd.DataFrame(out, columns=["n_words", "repeated_words", "repeated_share", "class_distance", "word_distance"])
            got.insert(0, "k", pdf["k"].to_numpy())
            yield got.astype({"k": pdf["k"].dtype, "class_distance": float, "word_distance": float})

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), (language(lang) if lang else F.lit("und")).alias("la"))
    if joined:
        rows = salted_join(rows, references.withColumnRenamed("lang", "la"), ["la"], F.xxhash64("k", "t"), how="left", hot_from=docs.select(language(lang).alias("la")))
    got = rows.mapInPandas(measure, f"k {kind}, n_words int, repeated_words int, repeated_share double, class_distance double, word_distance double")
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return got.select(F.col("k").alias(key), "n_words", "repeated_words", "repeated_share", nan("class_distance"), nan("word_distance"))
