"""Points in regions and points near points, by slabs.

Each region is cut at the x of every vertex into vertical slabs. Within a slab its edges do not
cross and are ordered by y, so the number of edges below a point tells whether the point is inside
(even-odd rule: holes and several pieces need no special case, and ring direction does not matter).
A region lies on the grid whose cells are as wide as its extent, rounded up to a power of two, so it
meets four cells or a few more, whatever its size. A row holds the slabs of a region in one cell,
sorted; edges below the cell are only counted and those above it left out. A point meets the rows
of its cells in an equi-join and finds its slab, and then its place among the slab's edges, by two
binary searches. "Within a distance" is the same search with squares around the points as regions,
followed by the exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import salted_join, tasks


def crs_code(c: Column | str) -> Column:
    """One spelling per reference system: the EPSG number where one can be read, else the text in
    upper case without spaces; null for null and blank."""
    t = F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", ""))
    zone = F.regexp_extract(t, r"UTMZONE(\d{1,2})([NS])", 1)
    south = F.regexp_extract(t, r"UTMZONE(\d{1,2})([NS])", 2) == "S"
    number = F.regexp_extract(t, r"^(?:.*EPSG.*?[:/])?(\d{4,6})$", 1)
    return (
        F.when(t == "", None)
        .when(number != "", number)
        .when(zone != "", (F.when(south, 32700).otherwise(32600) + F.when(zone != "", zone).cast("int")).cast("string"))
        .otherwise(t)
    )


def vertices(rings: str = "rings") -> Column:
    """All vertices of all rings that have both coordinates."""
    flat = F.flatten(F.filter(F.col(rings), lambda r: r.isNotNull()))
    return F.filter(flat, lambda v: v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"]))


def extent_centre(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Adds ``cx``, ``cy``: the middle of the extent of all vertices; null without vertices."""
    v = df.withColumn("_v", vertices(rings))
    xs, ys = F.transform("_v", lambda p: p["x"]), F.transform("_v", lambda p: p["y"])
    mid = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    return v.withColumns({"cx": mid(xs), "cy": mid(ys)}).drop("_v")


def _cut(ring_list: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, float, list[float], list[float]]]:
    """Slabs of one region: x0, x1 and the y of the ordered edges at x0 and at x1."""
    ax, ay, bx, by = [], [], [], []
    for xs, ys in ring_list:
        ok = np.isfinite(xs) & np.isfinite(ys)
        xs, ys = xs[ok], ys[ok]
        if len(xs) < 3:
            continue
        nx, ny = np.roll(xs, -1), np.roll(ys, -1)  # closes open rings; a closed one gets an edge of no length
        ax.append(xs), ay.append(ys), bx.append(nx), by.append(ny)
    if not ax:
        return []
    x0, y0, x1, y1 = map(np.concatenate, (ax, ay, bx, by))
    swap = x0 > x1
    x0, x1 = np.where(swap, x1, x0), np.where(swap, x0, x1)
    y0, y1 = np.where(swap, y1, y0), np.where(swap, y0, y1)
    slanted = x0 < x1  # upright edges bound no slab from above or below
    x0, y0, x1, y1 = x0[slanted], y0[slanted], x1[slanted], y1[slanted]
    cuts = np.unique(np.concatenate([x0, x1]))
    out = []
    todo = [(cuts[k], cuts[k + 1]) for k in range(len(cuts) - 1)]
    first, last = np.searchsorted(cuts, x0), np.searchsorted(cuts, x1)
    spans = np.repeat(np.arange(len(x0)), last - first)
    slab = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(x0) else np.zeros(0, int)
    order = np.argsort(slab, kind="stable")
    spans, slab = spans[order], slab[order]
    starts = np.searchsorted(slab, np.arange(len(todo) + 1))
    for k, (a, b) in enumerate(todo):
        e = spans[starts[k] : starts[k + 1]]
        pieces = [(a, b)]
        while pieces:
            p, q = pieces.pop()
            w = x1[e] - x0[e]
            lo = y0[e] + (y1[e] - y0[e]) * ((p - x0[e]) / w)
            hi = y0[e] + (y1[e] - y0[e]) * ((q - x0[e]) / w)
            o = np.lexsort((hi - lo, lo + hi))
            lo, hi = lo[o], hi[o]
            bad = np.flatnonzero((np.diff(lo) < -1e-9) | (np.diff(hi) < -1e-9))
            if len(bad) and q - p > 1e-6:  # edges of an invalid ring cross here: cut at the crossing
                i = bad[0]
                d0, d1 = lo[i + 1] - lo[i], hi[i + 1] - hi[i]
                m = p + (q - p) * (d0 / (d0 - d1)) if d0 != d1 else (p + q) / 2
                m = m if p + 1e-7 < m < q - 1e-7 else (p + q) / 2
                pieces += [(m, q), (p, m)]
                continue
            if len(lo):
                out.append((float(p), float(q), lo.tolist(), hi.tolist()))
    return out


def _spread(slabs: list[tuple[float, float, list[float], list[float]]], cell: float):
    """Rows cx, cy, x0, x1, base, start, lo, hi of one region: its slabs by cell of the grid.

    Slab k lies between x0[k] and x1[k], ``base[k]`` of its edges pass below the cell, and those
    that may pass through it stand at start[k]..start[k + 1] of ``lo`` and ``hi``.
    """
    out: dict[tuple[int, int], tuple[list, ...]] = {}
    for p, q, lo, hi in slabs:
        low, high = np.asarray(lo), np.asarray(hi)
        for cx in range(int(np.floor(p / cell)), int(np.floor(q / cell)) + 1):
            a, b = max(p, cx * cell), min(q, (cx + 1) * cell)
            if a >= b:
                continue
            at = low + (high - low) * ((a - p) / (q - p)), low + (high - low) * ((b - p) / (q - p))
            least, most = np.minimum(*at) - 1e-6, np.maximum(*at) + 1e-6  # room for rounding
            for cy in range(int(np.floor(least.min() / cell)), int(np.floor(most.max() / cell)) + 1):
                below, through = most < cy * cell, (most >= cy * cell) & (least <= (cy + 1) * cell)
                n = int(below.sum())
                if n % 2 or through.any():
                    x0, x1, base, start, los, his = out.setdefault((cx, cy), ([], [], [], [0], [], []))
                    x0.append(p), x1.append(q), base.append(n)
                    los.extend(low[through].tolist()), his.extend(high[through].tolist())
                    start.append(len(los))
    for (cx, cy), row in out.items():
        yield cx, cy, *row


def _level(rings: str) -> Column:
    """The power of two above a region's extent; null for regions without area to search."""
    v = vertices(rings)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return F.when(extent > 0, F.ceil(F.log2(extent)).cast("int"))


SLABS = "_level int, _cx bigint, _cy bigint, x0 array<double>, x1 array<double>, base array<int>, start array<int>, lo array<double>, hi array<double>"


def trapezoids(regions: DataFrame, cols: list[str], rings: str = "rings") -> DataFrame:
    """``cols`` and SLABS: one row per region and cell of the region's grid that it meets."""
    part = lambda a: F.transform(F.filter(F.col(rings), lambda r: r.isNotNull()), lambda r: F.transform(F.filter(r, lambda v: v.isNotNull()), lambda v: v[a]))
    kinds = dict(regions.dtypes)
    flat = regions.filter(F.col(rings).isNotNull()).select(*cols, _level(rings).alias("_level"), part("x").alias("_xs"), part("y").alias("_ys")).filter("_level is not null")
    names = [*cols, *[c.split()[0] for c in SLABS.split(", ")]]

    def cut(batches):
        for pdf in batches:
            got: dict[str, list] = {c: [] for c in names}
            for row in pdf.itertuples(index=False):
                keys, level = row[: len(cols)], row[len(cols)]
                slabs = _cut([(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(row[-2], row[-1])])
                for s in _spread(slabs, 2.0 ** int(level)):
                    for c, v in zip(names, (*keys, level, *s)):
                        got[c].append(v)
            yield pd.DataFrame(got)

    return flat.mapInPandas(cut, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", " + SLABS)


def _search(first: Column, last: Column, below) -> Column:
    """The first place from ``first`` to ``last`` that is not ``below``, by halving."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(last - first + 1)).cast("int")))

    def halve(s, _):
        mid = F.floor((s["l"] + s["h"]) / 2).cast("int")
        open_, under = s["l"] < s["h"], below(mid)
        return F.struct(F.when(open_ & under, mid + 1).otherwise(s["l"]).alias("l"), F.when(open_ & ~under, mid).otherwise(s["h"]).alias("h"))

    return F.aggregate(steps, F.struct(first.cast("int").alias("l"), last.cast("int").alias("h")), halve, lambda s: s["l"])


def _inside() -> Column:
    """Whether (_px, _py) is in the region of the row: its slab, then its place among the edges."""
    def odd(k: Column) -> Column:
        part = (F.col("_px") - F.col("x0")[k]) / (F.col("x1")[k] - F.col("x0")[k])
        height = lambda i: F.col("lo")[i] + (F.col("hi")[i] - F.col("lo")[i]) * part
        first, last = F.col("start")[k], F.col("start")[k + 1]
        below = _search(first, last, lambda i: height(i) <= F.col("_py")) - first + F.col("base")[k]
        return (F.col("_px") < F.col("x1")[k]) & (below % 2 == 1)

    slab = _search(F.lit(0), F.size("x0"), lambda i: F.col("x0")[i] <= F.col("_px")) - 1
    return F.exists(F.filter(F.array(slab), lambda k: k >= 0), odd)


def locate(points: DataFrame, x: str, y: str, slabs: DataFrame, levels: list[int], group: list[str], spread_by: str, hot_rows: int = 100_000) -> DataFrame:
    """Points joined with the regions that contain them; the columns of both, the slab's removed.

    ``group`` are columns in which point and region must agree, ``levels`` the grids that are in
    use. A cell with more than ``hot_rows`` points is salted. Left and lower borders belong to a
    region, right and upper ones do not. Points with null coordinates, or null in ``group``, are in
    no region.
    """
    at = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y))).withColumns({"_px": F.col(x), "_py": F.col(y)})
    cell = lambda n: F.struct(F.lit(n).cast("int").alias("_level"), F.floor(F.col(x) / 2.0**n).alias("_cx"), F.floor(F.col(y) / 2.0**n).alias("_cy"))
    if not levels:
        return at.join(slabs, group).limit(0).drop("_px", "_py", *[c.split()[0] for c in SLABS.split(", ")])
    at = at.withColumn("_cell", F.explode(F.array(*map(cell, levels)))) if len(levels) > 1 else at.withColumn("_cell", cell(levels[0]))
    at = at.select("*", "_cell.*").drop("_cell")
    met = salted_join(at, slabs, [*group, "_level", "_cx", "_cy"], F.col(spread_by), hot_rows)
    near = met.filter("_px >= x0[0] and _px < element_at(x1, -1)").filter(_inside())
    return near.drop("_px", "_py", *[c.split()[0] for c in SLABS.split(", ")])


def near_pairs(annotations: DataFrame, distance: float, key: str = "id", rings: str = "rings", crs: str = "crs", hot_rows: int = 100_000) -> DataFrame:
    """id_a, id_b, distance: places of one reference system at most ``distance`` apart, id_a < id_b.

    The place of an annotation is the middle of the extent of its vertices; rows without vertices,
    reference system or key have none. Around every place lies a square region; ``locate`` finds
    the places in it and the exact distance decides. Repeated rows give a pair once.
    """
    places = extent_centre(annotations.select(F.col(key).alias("id"), F.col(rings).alias("rings"), crs_code(crs).alias("crs"))).drop("rings")
    places = places.filter("id is not null and crs is not null and cx is not null").distinct()
    r = distance * (1 + 1e-9) + 1e-6
    corner = lambda sx, sy: F.struct((F.col("cx") + sx * r).alias("x"), (F.col("cy") + sy * r).alias("y"))
    squares = places.select("crs", F.col("id").alias("of_id"), F.col("cx").alias("of_x"), F.col("cy").alias("of_y"), F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"))
    squares = squares.repartition(tasks(squares))  # cutting is far dearer than reading a place
    # all squares have one size, but the rounding of their corners may cross a power of two
    levels = sorted({math.ceil(math.log2(2 * r * f)) for f in (1 - 1e-9, 1 + 1e-9)})
    met = locate(places, "cx", "cy", trapezoids(squares, ["crs", "of_id", "of_x", "of_y"]), levels, ["crs"], "id", hot_rows)
    dx, dy = F.col("cx") - F.col("of_x"), F.col("cy") - F.col("of_y")
    near = met.filter(F.col("id") < F.col("of_id")).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= distance * distance)
    return near.groupBy(F.col("id").alias("id_a"), F.col("of_id").alias("id_b")).agg(F.min(F.sqrt("d2")).alias("distance"))


def containing_regions(points: DataFrame, regions: DataFrame, group: list[str], point_key: str, region_key: str, x: str = "x", y: str = "y", rings: str = "rings", hot_rows: int = 100_000) -> DataFrame:
    """``point_key``, region_id: every region that contains the point; points in none have no row.

    The grids in use, one per power of two of the regions' extents, are looked up before.
    """
    shapes = regions.select(*group, F.col(region_key).alias("region_id"), F.col(rings).alias("rings"))
    pts = points.select(*group, F.col(point_key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    levels = [r["_level"] for r in shapes.select(_level("rings").alias("_level")).distinct().filter("_level is not null").orderBy("_level").collect()]
    return locate(pts, "x", "y", trapezoids(shapes, [*group, "region_id"]), levels, group, point_key, hot_rows).select(point_key, "region_id").distinct()
