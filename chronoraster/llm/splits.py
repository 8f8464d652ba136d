"""Splits that keep related records together.

Records that share an entity, or a tile with another entity's records, are linked; linked entities
form components, and a component goes to one split as a whole. Components are found by random-mate
contraction: each round every vertex draws a coin, tails collapse into a neighbouring head, and
the edges are rewritten, until none is left. The rounds are then unwound to labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, keep
from ..skew import salted_join

MAX_SHARES = 1000
BUCKETS = 4096
#: Rows from which a key is looked at as hot in the joins of links.
HOT_ROWS = 1_000_000


def random_mate(edges: DataFrame, seed: int = 17, max_rounds: int = 500) -> DataFrame:
    """vertex, label for every vertex of ``edges`` (u, v): equal labels in one component only.

    In a round a quarter of the vertices collapse on average, so the rounds grow with the logarithm
    of the largest component. Each round's parents and edges are tables in the shared folder; the
    edges shrink until the table is empty. Self-loops, repeated edges and nulls are passed over; no
    edges give no labels.
    """
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    pairs = edges.filter("u is not null and v is not null").select(lo.alias("u"), hi.alias("v")).filter("u <> v").distinct()
    left = keep(pairs, "edges")
    parents: list[DataFrame] = []
    for rnd in range(max_rounds):
        if left.isEmpty():
            break
        head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(rnd)), F.lit(2)) == 1
        into = F.when(~head("u") & head("v"), F.struct(F.col("u").alias("child"), F.col("v").alias("parent"))).when(
            head("u") & ~head("v"), F.struct(F.col("v").alias("child"), F.col("u").alias("parent"))
        )
        step = keep(left.select(into.alias("m")).filter("m is not null").groupBy("m.child").agg(F.min("m.parent").alias("parent")), "parents")
        moved = left
        for end in ("u", "v"):
            to = step.select(F.col("child").alias(end), F.col("parent").alias(f"_{end}"))
            moved = salted_join(moved, to, [end], F.col("v" if end == "u" else "u"), HOT_ROWS, how="left", hot_from=left).withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        rest = keep(moved.filter("u <> v").select(lo.alias("u"), hi.alias("v")).distinct(), "edges")
        drop_kept(left)
        left = rest
        parents.append(step)
    else:
        raise RuntimeError(f"edges remain after {max_rounds} rounds")
    drop_kept(left)
    if not parents:
        return pairs.select(F.col("u").alias("vertex"), F.col("u").alias("label")).limit(0)
    labels, stage = None, None
    for k, step in enumerate(reversed(parents)):
        now = step.select(F.col("child").alias("vertex"), F.col("parent").alias("label"))
        if labels is not None:
            above = labels.select(F.col("vertex").alias("label"), F.col("label").alias("_up"))
            now = now.join(above, "label", "left").select("vertex", F.coalesce("_up", "label").alias("label")).unionByName(labels)
        labels = now
        if k % 3 == 2:
            labels, old = keep(labels, "labels"), stage
            if old is not None:
                drop_kept(old)
            stage = labels
    roots = labels.select(F.col("label").alias("vertex"), "label").distinct()
    out = keep(labels.unionByName(roots), "labels")
    drop_kept(*parents, *([stage] if stage is not None else []))
    return out


def shared_tile_edges(pixels: DataFrame, entity: str, tile: list[str]) -> DataFrame:
    """u, v: each entity of a tile linked with the tile's smallest one, so n entities give n - 1 links."""
    held = pixels.filter(F.col(entity).isNotNull()).dropna(subset=tile).select(F.col(entity).alias("v"), *tile).distinct()
    lead = held.groupBy(*tile).agg(F.min("v").alias("u"))
    return salted_join(held, lead, tile, F.col("v"), HOT_ROWS, hot_from=pixels).filter("u <> v").select("u", "v")


def masked_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels inside an annotation; null and no-data masks are outside."""
    return pixels.filter(F.col("mask") == 1)


def linked_pairs(labels: DataFrame, min_rows: int = 2000) -> DataFrame:
    """id_a, id_b of each two members of a component, id_a < id_b; large components are salted."""
    a = labels.select(F.col("vertex").alias("id_a"), "label")
    b = labels.select(F.col("vertex").alias("id_b"), "label")
    return salted_join(a, b, ["label"], F.col("id_a"), min_rows).filter("id_a < id_b").select("id_a", "id_b").distinct()


def component_members(labels: DataFrame) -> DataFrame:
    """id, component, n_members: one row per linked entity; a component is named by its smallest one."""
    sizes = labels.groupBy("label").agg(F.min("vertex").alias("component"), F.count(F.lit(1)).alias("n_members"))
    return salted_join(labels, sizes, ["label"], F.col("vertex"), HOT_ROWS).select(F.col("vertex").alias("id"), "component", "n_members")


def _shares(shares: DataFrame) -> list[tuple[str, float]]:
    rows = shares.groupBy("split_name").agg(F.sum("share").alias("share")).filter("split_name is not null and share > 0").limit(MAX_SHARES + 1).collect()
    if not 0 < len(rows) <= MAX_SHARES:
        raise ValueError(f"between 1 and {MAX_SHARES} splits with a positive share are needed")
    total = sum(r["share"] for r in rows)
    return sorted(((r["split_name"], r["share"] / total) for r in rows), key=lambda s: (-s[1], s[0]))


def cut_by_weight(groups: DataFrame, shares: DataFrame, seed: int = 17) -> DataFrame:
    """Adds ``split_name`` to ``groups`` (group_key, weight) so that the weights meet the shares.

    Groups stand in a row and the row is cut at the cumulative shares; a group belongs to the split
    that holds its middle. Groups above a 200th of the smallest split come first, heaviest first,
    and therefore into the largest split; the others follow in hashed order. A cut misses its place
    by at most half the group it meets. Running weights are taken in hashed buckets whose totals
    (4097 rows) are summed up on their own, so no task sees all groups.
    """
    parts = _shares(shares)
    total = groups.agg(F.sum("weight")).first()[0] or 0
    heavy = F.col("weight") > total * parts[-1][1] / 200
    h = F.xxhash64("group_key", F.lit(seed))
    placed = groups.withColumns({"_b": F.when(heavy, 0).otherwise(1 + F.pmod(h, F.lit(BUCKETS))), "_h": F.when(heavy, -F.col("weight")).otherwise(h)})
    sums = placed.groupBy("_b").agg(F.sum("weight").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("weight").over(Window.partitionBy("_b").orderBy("_h", "group_key").rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.col("_before") + F.col("_run") - F.col("weight") / 2) / F.lit(float(total or 1))
    split, edge = F.lit(parts[-1][0]), 1.0
    for name, share in reversed(parts[:-1]):
        edge = sum(s for n, s in parts[: [p[0] for p in parts].index(name) + 1])
        split = F.when(middle < edge, F.lit(name)).otherwise(split)
    return placed.withColumn("_run", run).join(F.broadcast(before), "_b").withColumn("split_name", split).drop("_b", "_h", "_before", "_run")


def grouped_splits(pixels: DataFrame, shares: DataFrame, key: str = "pixel_id", entity: str = "id", tile: tuple[str, ...] = ("cube_name", "tile_i", "tile_j"), seed: int = 17) -> DataFrame:
    """key, entity, group_key, split_name: one row per masked pixel row.

    Entities linked through tiles share a split, and so do the tiles that hold them: a masked pixel
    without entity follows the entities of its tile, one in a tile without any entity forms a group
    with its tile, and one without entity and tile is a group of its own. Pixels with null or
    no-data mask are left out. Repeated rows stay and count. An empty table gives no rows. Other
    columns are passed over. Raises if no split has a positive share.
    """
    tile = list(tile)
    m = masked_pixels(pixels).select(F.col(key).alias("_k"), F.col(entity).alias("_e"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tile)])
    t = [f"_t{i}" for i in range(len(tile))]
    has_tile = F.lit(True)
    for c in t:
        has_tile = has_tile & F.col(c).isNotNull()
    # counts per entity and tile are far fewer than pixels; all but the last join run on them
    units = keep(m.groupBy("_e", *t).agg(F.count(F.lit(1)).alias("weight")), "units")
    labels = random_mate(shared_tile_edges(units, "_e", t), seed)
    named = units.filter("_e is not null")
    ids = named.groupBy("_e").agg(F.sum("weight").alias("weight")).join(labels.select(F.col("vertex").alias("_e"), F.col("label")), "_e", "left")
    ids = keep(ids.select("_e", F.concat(F.lit("e:"), F.coalesce("label", "_e").cast("string")).alias("group_key"), "weight"), "ids")
    lead = named.filter(has_tile).groupBy(*t).agg(F.min("_e").alias("_e")).join(ids.select("_e", "group_key"), "_e").drop("_e")
    own: Column = F.concat(F.lit("t:"), F.concat_ws("/", *t))
    bare = units.filter(F.col("_e").isNull() & has_tile).join(lead, t, "left").select(*t, F.coalesce("group_key", own).alias("group_key"), "weight")
    loose = m.filter(F.col("_e").isNull() & ~has_tile).withColumn("group_key", F.concat(F.lit("p:"), F.coalesce(F.col("_k").cast("string"), F.lit("null"))))
    weights = ids.select("group_key", "weight").unionByName(bare.select("group_key", "weight")).unionByName(loose.groupBy("group_key").agg(F.count(F.lit(1)).alias("weight")))
    splits = keep(cut_by_weight(weights.groupBy("group_key").agg(F.sum("weight").alias("weight")), shares, seed).select("group_key", "split_name"), "splits")
    id_split = ids.select("_e", "group_key").join(splits, "group_key")
    tile_split = bare.select(*t, "group_key").join(splits, "group_key")
    out = ["_k", "_e", "group_key", "split_name"]
    whole = (
        salted_join(m.filter("_e is not null").select("_k", "_e"), id_split, ["_e"], F.col("_k"), hot_from=named, weight="weight").select(*out)
        .unionByName(salted_join(m.filter(F.col("_e").isNull() & has_tile), tile_split, t, F.col("_k"), hot_from=units.filter(F.col("_e").isNull() & has_tile), weight="weight").select(*out))
        .unionByName(loose.join(splits, "group_key").select(*out))
    )
    return whole.select(F.col("_k").alias(key), F.col("_e").alias(entity), "group_key", "split_name")


def split_report(assigned: DataFrame, shares: DataFrame, entity: str = "id") -> DataFrame:
    """split_name, wanted_share, got_share, n_records, n_groups per split; an empty split has zeros."""
    per_group = assigned.groupBy("split_name", "group_key").agg(F.count(F.lit(1)).alias("n"))
    got = per_group.groupBy("split_name").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_groups"))
    parts = _shares(shares)
    wanted = assigned.sparkSession.createDataFrame(parts, "split_name string, wanted_share double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole = wanted.join(got, "split_name", "left").select("split_name", "wanted_share", zero("n_records"), zero("n_groups"))
    return whole.withColumn("got_share", F.try_divide(F.col("n_records"), F.sum("n_records").over(Window.partitionBy())))
