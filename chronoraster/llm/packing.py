"""Filling fixed-capacity containers by multiway differencing.

Items are dealt into shards of bounded size by hash. In a shard the differencing method of
Karmarkar and Karp keeps partial partitions of all windows and merges the two with the largest
differences, large sums of one against small sums of the other, until one partition is left; its
windows are nearly equal. Windows that exceed the capacity give up small items, first to windows
with room and then to further windows, which are partitioned the same way, so the number of
windows rises. An item above the capacity is cut; its full pieces are containers.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from ..skew import tasks

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SPECS = 100
#: Window counts to start from, in least possible ones, and the load from which a window stays as it is.
STARTS = (0.8, 0.85, 0.9, 0.95, 1.0)
ROOM_LEFT = 0.97

_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file with ranks, loaded once per worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """key, n_tokens of whole texts; 0 for null and empty ones.

    The vocabulary is read on the driver's machine and sent to the executors as a file.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rstrip("/").rpartition("/")[2]

    def count(batches):
        enc = encoder(SparkFiles.get(name))
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "n_tokens": np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]), np.int64, len(pdf))})

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(count, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def difference_partition(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window 0..k-1 of each item, by k-way differencing."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, int)
    # a node is a partial partition: its sums, descending, less the smallest; leaves hold one item
    sums: list[np.ndarray | None] = [None] * n
    kids: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def of(i: int) -> np.ndarray:
        if sums[i] is None:
            leaf = np.zeros(k, np.int64)
            leaf[0] = sizes[i]
            return leaf
        return sums[i]

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = of(a) + of(b)[::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        merged -= merged[-1]
        for i in (a, b):
            sums[i] = None  # not needed any more
        kids.append((a, b, order))
        sums.append(merged)
        heapq.heappush(heap, (-int(merged[0]), len(sums) - 1))
    window = np.zeros(n, int)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        i, slots = todo.pop()
        if kids[i] is None:
            window[i] = slots[0]
            continue
        a, b, order = kids[i]
        plain = np.empty(k, int)
        plain[order] = slots
        todo += [(a, plain), (b, plain[::-1])]
    return window


def _differenced(sizes: np.ndarray, capacity: int, start: float) -> np.ndarray:
    """Windows within the capacity, from ``start`` times the least possible number of windows on.

    Windows above the capacity, and those with room left beside small items, give up their
    smallest items; these go where they leave the least room, largest first. What fits nowhere is
    partitioned again into windows of its own, so the number of windows rises until all is placed.
    """
    window = np.full(len(sizes), -1)
    loads: list[int] = []
    left = np.arange(len(sizes))
    while len(left):
        s = sizes[left]
        k = max(1, int(np.ceil(s.sum() / capacity * (start if not loads else 1))))
        w = difference_partition(s, k)
        load = np.bincount(w, weights=s, minlength=k).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(k)]
        for i in np.argsort(s, kind="stable"):
            members[w[i]].append(i)
        out: list[int] = []
        for x, m in enumerate(members):
            if not ROOM_LEFT * capacity <= load[x] <= capacity:
                while len(m) > 1 and (load[x] > capacity or s[m[0]] < capacity / 4):
                    i = m.pop(0)
                    load[x] -= s[i]
                    out.append(i)
            window[left[m]] = len(loads) + x
        loads += load.tolist()
        room = sorted((capacity - v, x) for x, v in enumerate(loads))
        rest = []
        for i in sorted(out, key=lambda i: -s[i]):
            at = bisect.bisect_left(room, (s[i], -1))
            if at == len(room):
                rest.append(i)
                continue
            free, x = room.pop(at)
            window[left[i]] = x
            loads[x] += int(s[i])
            bisect.insort(room, (free - int(s[i]), x))
        left = left[np.array(rest, int)]
    return np.unique(window, return_inverse=True)[1] if len(window) else window


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, no window above ``capacity``; no item may exceed it.

    The differencing is tried from several window counts, and the one with the fewest windows wins.
    """
    tries = (_differenced(sizes, capacity, f) for f in STARTS)
    return min(tries, key=lambda w: int(w.max(initial=-1)))


def packed(sizes: DataFrame, specs: DataFrame, key: str = "doc_id", shard_items: int = 1024) -> DataFrame:
    """spec_id, capacity_tokens, container, key, doc_tokens, copy_no, piece_no, token_start, n_tokens.

    Every row of ``sizes`` (key, n_tokens) appears for every capacity: whole if it fits, else cut
    into full pieces, each a container, and a rest that is packed with other items. Items of size 0
    (null or empty texts) lie in some container, too. Repeated rows are items of their own: key,
    ``doc_tokens`` (the whole size) and ``copy_no`` name a row of the input; null keys are packed like others. Capacities that are null or not
    positive are passed over. No items give no containers.
    """
    rows = specs.filter("spec_id is not null and capacity_tokens > 0").distinct().limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"at most {MAX_SPECS} capacities")
    kind = dict(sizes.dtypes)[key]
    if not rows:
        return sizes.sparkSession.createDataFrame([], f"spec_id int, capacity_tokens int, container string, {key} {kind}, doc_tokens bigint, copy_no bigint, piece_no int, token_start bigint, n_tokens bigint")
    counted = keep(sizes.groupBy(F.col(key).alias("k"), F.col("n_tokens").alias("n")).agg(F.count(F.lit(1)).alias("c")), "sizes")
    shards = max(1, -(-(counted.agg(F.sum("c")).first()[0] or 0) // shard_items))
    items = counted.select("k", "n", F.explode(F.sequence(F.lit(1), "c")).alias("copy_no"))
    each = F.explode(F.array(*[F.struct(F.lit(int(r["spec_id"])).alias("spec_id"), F.lit(int(r["capacity_tokens"])).alias("capacity_tokens")) for r in rows]))
    cut = items.withColumn("_s", each).select("k", "n", "copy_no", "_s.*").withColumn("full", F.floor(F.col("n") / F.col("capacity_tokens")).cast("int"))
    full = cut.filter("full > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    full = full.select(
        "spec_id", "capacity_tokens", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("k").cast("string"), F.lit("null")), "n", "copy_no", "piece_no").alias("container"), "k", "n", "copy_no", "piece_no",
        (F.col("piece_no").cast("bigint") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").cast("bigint").alias("n_tokens"),
    )
    rest = cut.withColumn("rest", F.col("n") - F.col("full").cast("bigint") * F.col("capacity_tokens")).filter("rest > 0 or n = 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("k", "n", "copy_no", "spec_id"), F.lit(shards)))

    def window(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "k", "n", "copy_no"], kind="stable", ignore_index=True)
        spec, shard = pdf["spec_id"].iloc[0], pdf["shard"].iloc[0]
        w = pack(pdf["rest"].to_numpy(np.int64), int(pdf["capacity_tokens"].iloc[0]))
        return pd.DataFrame({
            "spec_id": pdf["spec_id"], "capacity_tokens": pdf["capacity_tokens"], "container": [f"{spec}-{shard}-{x}" for x in w], "k": pdf["k"], "doc_tokens": pdf["n"], "copy_no": pdf["copy_no"], "piece_no": pdf["full"],
            "token_start": pdf["full"].astype("int64") * pdf["capacity_tokens"], "n_tokens": pdf["rest"],
        })

    schema = f"spec_id int, capacity_tokens int, container string, k {kind}, doc_tokens bigint, copy_no bigint, piece_no int, token_start bigint, n_tokens bigint"
    return full.select("spec_id", "capacity_tokens", "container", "k", F.col("n").alias("doc_tokens"), F.col("copy_no").cast("bigint").alias("copy_no"), "piece_no", "token_start", "n_tokens").unionByName(
        rest.select("spec_id", "capacity_tokens", "shard", "k", "n", F.col("copy_no").cast("bigint").alias("copy_no"), "full", "rest").repartition(tasks(rest), "spec_id", "shard").groupBy("spec_id", "shard").applyInPandas(window, schema)
    ).withColumnRenamed("k", key)


def fill_report(packed_rows: DataFrame) -> DataFrame:
    """spec_id, capacity_tokens, n_containers, n_tokens, fill: the share of the containers' room in use."""
    load = packed_rows.groupBy("spec_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("load"))
    return load.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("load").alias("n_tokens"), F.max("load").alias("largest"), (F.sum("load") / (F.count(F.lit(1)) * F.col("capacity_tokens"))).alias("fill")
    )
