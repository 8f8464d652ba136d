"""Statistics of pixels in and around polygons.

Pixels and polygons meet in an equi-join on coarse cells (``candidates``); the exact rule then
decides. One grouped query serves all scenes and all annotations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.predicates import BAD_CLASSES, VEGETATION, bad_percent, good_gate, is_bad, time_valid
from ..session import keep
from ..skew import salted_join

#: Days of a group with at most so many vegetation pixels are looked at whole by a growing buffer.
FEW = 64


def candidates(pixels: DataFrame, annotations: DataFrame, group: list[str], reach: float, cell: float = 640.0, key: str = "id", rings: str = "rings", spread_by: str = "pixel_id") -> DataFrame:
    """Pixels with every annotation whose bounding box, widened by ``reach``, holds their centre.

    Adds ``ann_id`` and ``edges``. ``group`` are columns in which both must agree. Annotations
    without vertices, pixels without coordinates and nulls in ``group`` meet nothing. Pixel columns
    named like the annotation's are kept as the pixel's.
    """
    box = G.bounding_box(F.col(rings), reach)
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    shapes = annotations.select(*group, F.col(key).alias("ann_id"), G.edges(F.col(rings)).alias("edges"), box.alias("_b")).filter("_b.minx is not null and _b.miny is not null and ann_id is not null")
    placed = shapes.withColumn("_cx", F.explode(cells(F.col("_b.minx"), F.col("_b.maxx")))).withColumn("_cy", F.explode(cells(F.col("_b.miny"), F.col("_b.maxy"))))
    at = pixels.filter("x is not null and y is not null").withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    met = salted_join(at, placed, [*group, "_cx", "_cy"], F.col(spread_by))
    return met.filter("x between _b.minx and _b.maxx and y between _b.miny and _b.maxy").drop("_b", "_cx", "_cy")


def pixels_in(pixels: DataFrame, annotations: DataFrame, group: list[str], all_touched: bool = False, pixel_size: float = 10.0, **kw) -> DataFrame:
    """Pixels whose centre is inside an annotation, or whose square meets it; adds ``ann_id``."""
    met = candidates(pixels, annotations, group, pixel_size if all_touched else 0.0, **kw)
    x, y = F.col("x"), F.col("y")
    rule = G.touches_square(F.col("edges"), x, y, pixel_size / 2) if all_touched else G.contains(F.col("edges"), x, y)
    return met.filter(rule).drop("edges")


def pixels_around(pixels: DataFrame, annotations: DataFrame, group: list[str], inner: float, outer: float, pixel_size: float = 0.0, **kw) -> DataFrame:
    """Pixels with ``inner`` < distance <= ``outer`` of an annotation; adds ``ann_id``, ``dist``.

    ``inner`` below 0 takes the annotation in. With a ``pixel_size`` pixels are squares, and one
    belongs to the ring if any part of it does (the all-touched rule): its nearest part is within
    ``outer`` and its centre or a corner beyond ``inner``. ``dist`` is always the centre's.
    """
    half = pixel_size / 2
    slack = half * math.sqrt(2) * (1 + 1e-9)
    met = candidates(pixels, annotations, group, outer + slack, **kw)
    # a generated column is computed once; a projected one would be copied into every filter on it
    once = F.explode(F.array(G.distance(F.col("edges"), F.col("x"), F.col("y"))))
    met = met.withColumn("dist", once)
    d, e, x, y = F.col("dist"), F.col("edges"), F.col("x"), F.col("y")
    rule = (d > inner) & (d <= outer)
    if half:
        # a square's parts are as far as its centre, give or take the slack, so few need a second look
        corner = lambda sx, sy: G.distance(e, x + sx * half, y + sy * half) > inner
        beyond = (d <= inner) & (d > inner - slack) & (corner(-1, -1) | corner(-1, 1) | corner(1, -1) | corner(1, 1))
        within = (d > outer) & (d <= outer + slack) & (G.square_distance2(e, x, y, half) <= outer * outer)
        rule = rule | beyond | within
    return met.filter(rule).drop("edges")


def gated_ndvi(inside: DataFrame, by: list[str], ndvi: str = "ndvi", scl: str = "scl", threshold: float = 70.0) -> DataFrame:
    """``by``, mean, median, n: index over good pixels where at least ``threshold`` percent are good.

    Pixels count if class and index are present; n counts them. Below the gate mean and median are
    null, and n stays.
    """
    v = F.col(scl).isNotNull() & F.col(ndvi).isNotNull()
    good = v & ~is_bad(F.col(scl))
    n, g = F.count(F.when(v, 1)), F.count(F.when(good, 1))
    open_ = good_gate(g, n, threshold)
    x = F.when(good, F.col(ndvi))
    return inside.groupBy(*by).agg(F.when(open_, F.avg(x)).alias("mean"), F.when(open_, F.percentile(x, 0.5)).alias("median"), n.alias("n"))


def _need(factor: int) -> Column:
    return F.greatest(F.lit(1), F.col("n") * factor).alias("_need")


def in_growing_reach(pixels: DataFrame, annotations: DataFrame, counts: DataFrame, group: list[str], by: list[str], ndvi: str = "ndvi", scl: str = "scl", first: float = 100.0, growth: float = 1.5, rungs: int = 8, factor: int = 5, empty_limit: float = 500.0, key: str = "id", rings: str = "rings") -> DataFrame:
    """``by``, dist, _need, index and class: the vegetation that decides ``growing_buffer_ndvi``.

    Of each annotation and day in ``counts`` it holds all vegetation up to a rung that is enough,
    and leaves out those that no rung can serve. ``by`` is ann_id and columns of ``group``. The rung
    is bounded from above, as no pixel is farther from a polygon than from one of its vertices:
    first by the vegetation in the cell around the vertex whose diagonal is the radius, then by
    the distances to the vertex. Only pixels within the last bound are kept, and ``dist`` is measured
    against the edges only where extent and vertex differ in the rung; else it is the vertex's.
    Pairs so grow with annotations and not with annotations times pixels of a day.
    """
    radii = [first * growth**k for k in range(rungs)]
    slack = 1 + 1e-9
    radius = F.element_at(F.array(*[F.lit(float(r)) for r in radii]), F.col("_k") + 1)
    of = lambda d2: F.least(*[F.when(d2 <= r * r, k).otherwise(rungs) for k, r in enumerate(radii)])
    on = F.col
    veg = keep(pixels.filter((on(scl) == VEGETATION) & on(ndvi).isNotNull()).filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*group, "x", "y", ndvi, scl), "vegetation")
    days = veg.groupBy(*group).agg(F.count(F.lit(1)).alias("_v"))
    same = F.count(F.lit(1)).over(Window.partitionBy(key))
    shapes = keep(annotations.select(*[c for c in group if c not in by], key, rings, same.alias("_same")).select("*", F.monotonically_increasing_id().alias("_shape")), "shapes")
    edge = F.get(G.edges(on(rings)), F.lit(0))
    anchors = shapes.select(*[c for c in group if c not in by], on(key).alias("ann_id"), "_shape", "_same", G.bounding_box(on(rings)).alias("_b"), edge.alias("_e")).filter("_e is not null")
    asked = counts.select(*by, _need(factor)).join(anchors, "ann_id").join(days, group).filter("_v >= _need or _same > 1")
    probes = keep(asked.select(*group, "ann_id", "_shape", "_need", "_v", on("_e.ax").alias("_ax"), on("_e.ay").alias("_ay"), "_b"), "probes")

    # a cell whose diagonal is the radius lies within it of any of its points
    sizes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r / math.sqrt(2) / slack).alias("s")) for k, r in enumerate(radii)])
    cell = lambda x, y: {"_k": on("_l.k"), "_cx": F.floor(on(x) / on("_l.s")), "_cy": F.floor(on(y) / on("_l.s"))}
    crowded = veg.join(days.filter(on("_v") > FEW), group).select(*group, "x", "y", F.explode(sizes).alias("_l")).withColumns(cell("x", "y"))
    held = crowded.groupBy(*group, "_k", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_held"))
    looked = probes.filter(on("_v") > FEW).select(*group, "ann_id", "_need", "_ax", "_ay", F.explode(sizes).alias("_l")).withColumns(cell("_ax", "_ay")).drop("_l", "_ax", "_ay")
    bound = looked.join(held, [*group, "_k", "_cx", "_cy"]).filter("_held >= _need").groupBy(*by).agg(F.min("_k").alias("_k"))
    bounded = probes.join(bound, by, "left").withColumn("_k", F.coalesce("_k", F.lit(rungs - 1)))

    def met(asking: DataFrame) -> DataFrame:
        """Vegetation within the radius of the rung ``_k`` of the extent; a crowded day by cells of its levels."""
        r, width = radius, F.greatest(F.lit(640.0), 2 * radius)
        level = F.when(on("_v") > FEW, F.greatest(on("_k"), F.lit(sum(2 * x < 640 for x in radii) - 1))).otherwise(-1)
        reach = asking.withColumns({"_r": r * slack, "_w": F.when(on("_v") > FEW, width), "_level": level})
        cells = lambda lo, hi: F.when(on("_w").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.floor((on(lo) - on("_r")) / on("_w")), F.floor((on(hi) + on("_r")) / on("_w"))))
        placed = reach.withColumn("_cx", F.explode(cells("_b.minx", "_b.maxx"))).withColumn("_cy", F.explode(cells("_b.miny", "_b.maxy"))).drop("_w", "_v", "_k")
        levels = reach.select(*group, "_level", "_w").distinct()
        at = lambda c: F.when(on("_w").isNull(), F.lit(0).cast("bigint")).otherwise(F.floor(on(c) / on("_w")))
        there = veg.join(levels, group).withColumns({"_cx": at("x"), "_cy": at("y")}).drop("_w")
        off = lambda c, lo, hi: F.greatest(on(lo) - on(c), on(c) - on(hi), F.lit(0.0))
        dx, dy = off("x", "_b.minx", "_b.maxx"), off("y", "_b.miny", "_b.maxy")
        return there.join(placed, [*group, "_level", "_cx", "_cy"]).withColumn("_low2", dx * dx + dy * dy).filter(on("_low2") <= on("_r") * on("_r"))

    dx, dy = on("x") - on("_ax"), on("y") - on("_ay")
    each = met(bounded).select(*by, "_need", of((dx * dx + dy * dy) * slack).alias("_at"), (on("_low2") <= (max([r for r in radii if r <= empty_limit], default=-1.0) * slack) ** 2).alias("_close"))
    tally = each.groupBy(*by).agg(F.max("_need").alias("_need"), F.max("_close").alias("_close"), *[F.sum((on("_at") <= k).cast("int")).alias(f"_n{k}") for k in range(rungs)])
    enough = F.least(*[F.when(on(f"_n{k}") >= on("_need"), k).otherwise(rungs - 1) for k in range(rungs)])
    nearest = keep(tally.filter("_close").select(*by, enough.alias("_k")), "rungs")
    d2 = dx * dx + dy * dy
    vertex = F.when(of(on("_low2") / slack) == of(d2 * slack), F.sqrt(d2))
    pairs = met(probes.join(nearest, by)).select(*by, "_shape", "_need", "x", "y", ndvi, scl, vertex.alias("_vertex"))
    # joined by ann_id alone, not by _shape, so the rows lie as all later groups need them
    edged = pairs.join(shapes.select(on(key).alias("ann_id"), on("_shape").alias("_of"), G.edges(on(rings)).alias("_edges")), "ann_id").filter(on("_shape") - on("_of") == 0)
    return edged.withColumn("dist", F.explode(F.array(F.when(on("_vertex").isNotNull(), on("_vertex")).otherwise(G.distance(on("_edges"), on("x"), on("y")))))).drop("_edges", "_shape", "_of", "_vertex")


def growing_buffer_ndvi(near: DataFrame, counts: DataFrame, by: list[str], ndvi: str = "ndvi", scl: str = "scl", first: float = 100.0, growth: float = 1.5, rungs: int = 8, factor: int = 5, empty_limit: float = 500.0) -> DataFrame:
    """``by``, radius, mean, median of vegetation in the smallest buffer with enough of it.

    Enough is ``factor`` times the annotation's own pixel count ``n`` in ``counts``, and at least
    one. Radii are ``first`` x ``growth``^k. Too little vegetation within the last rung, or none
    within ``empty_limit``, gives nulls. ``near`` holds ``dist`` per pixel (``pixels_around`` with
    inner < 0 and outer the last radius; or ``in_growing_reach``, which also brings ``_need``).
    """
    radii = [first * growth**k for k in range(rungs)]
    rung = F.lit(rungs)
    for k in range(rungs - 1, -1, -1):
        rung = F.when(F.col("dist") <= radii[k], k).otherwise(rung)
    veg = near.filter((F.col(scl) == VEGETATION) & F.col(ndvi).isNotNull()).withColumn("_k", rung).filter(F.col("_k") < rungs)
    group = Window.partitionBy(*by)
    # while a buffer is still empty, growth ends beyond the limit
    seen = F.min("_k").over(group) <= max([k for k in range(rungs) if radii[k] <= empty_limit], default=-1)
    within = F.count(F.lit(1)).over(group.orderBy("_k").rangeBetween(Window.unboundedPreceding, 0))
    needed = veg if "_need" in near.columns else veg.join(counts.select(*by, _need(factor)), by)
    enough = needed.withColumn("_enough", F.when(seen & (within >= F.col("_need")), F.col("_k")))
    picked = enough.withColumn("_pick", F.min("_enough").over(group))
    value = F.when(F.col("_k") <= F.col("_pick"), F.col(ndvi))
    stats = picked.groupBy(*by).agg(F.max("_pick").alias("_pick"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))
    radius = F.lit(None).cast("double")
    for k, r in enumerate(radii):
        radius = F.when(F.col("_pick") == k, F.lit(float(r))).otherwise(radius)
    return counts.select(*by).join(stats, by, "left").select(*by, radius.alias("radius"), "mean", "median")


def dating_stats(own: DataFrame, around: DataFrame, by: list[str]) -> DataFrame:
    """``by`` with ann_mean, ann_median, buf_mean, buf_median; annotations without buffer stay."""
    a = own.select(*by, F.col("mean").alias("ann_mean"), F.col("median").alias("ann_median"))
    b = around.select(*by, F.col("mean").alias("buf_mean"), F.col("median").alias("buf_median"))
    return a.join(b, by, "full_outer")


def gated_pair(inside: DataFrame, ring: DataFrame, by: list[str], ndvi: str = "ndvi", scl: str = "scl") -> DataFrame:
    """``by``, ndvi, ndvi_undist: mean in the annotation and over vegetation in the ring around it.

    Both are null, the row kept, where not more than half of the annotation's pixels are of the
    classes valid in time.
    """
    own = inside.groupBy(*by).agg(time_valid(F.col(scl)).alias("_ok"), F.avg(ndvi).alias("_own"))
    out = ring.groupBy(*by).agg(F.avg(F.when(F.col(scl) == VEGETATION, F.col(ndvi))).alias("_ring"))
    both = own.join(out, by, "left")
    return both.select(*by, F.when(F.col("_ok"), F.col("_own")).alias("ndvi"), F.when(F.col("_ok"), F.col("_ring")).alias("ndvi_undist"))


def signature(inside: DataFrame, by: list[str], bands: list[str], positive: bool = True) -> DataFrame:
    """``by``, band, mean in long form: mean of values above 0 (0 if none), or the plain mean."""
    each = [F.coalesce(F.avg(F.when(F.col(b) > 0, F.col(b).cast("double"))), F.lit(0.0)) if positive else F.avg(F.col(b).cast("double")) for b in bands]
    wide = inside.groupBy(*by).agg(*[e.alias(b) for e, b in zip(each, bands)])
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("mean")) for b in bands]))
    return wide.select(*by, pairs.alias("_p")).select(*by, "_p.band", "_p.mean")


def signature_json(long: DataFrame, key: str = "ann_id", date: str = "date") -> DataFrame:
    """key, signature: {date: {band: mean}} as JSON text, for export; dates as yyyyMMdd."""
    per = long.groupBy(key, date).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "mean")))).alias("m"))
    return per.groupBy(key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.date_format(date, "yyyyMMdd"), F.to_json("m")))))).alias("signature"))


def class_counts(inside: DataFrame, by: list[str], scl: str = "scl") -> DataFrame:
    """``by``, scl, n: pixels per class in long form, nulls left out."""
    return inside.filter(F.col(scl).isNotNull()).groupBy(*by, scl).agg(F.count(F.lit(1)).alias("n"))


def class_map(counts: DataFrame, by: list[str], scl: str = "scl") -> DataFrame:
    """``by``, classes MAP<class, count>, from the long form; at most one entry per class code."""
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(scl, "n")))).alias("classes"))


def reliable(counts: DataFrame, by: list[str], limit: float = 30.0, scl: str = "scl") -> DataFrame:
    """``by``, bad_ratio, keep: whether at most ``limit`` percent of the pixels are bad."""
    bad = F.try_divide(100.0 * F.sum(F.when(F.col(scl).isin(*BAD_CLASSES), F.col("n")).otherwise(0)), F.sum("n"))
    return counts.groupBy(*by).agg(bad.alias("bad_ratio")).withColumn("keep", F.coalesce(F.col("bad_ratio") <= limit, F.lit(False)))


def bad_ratio(pixels: DataFrame, by: list[str], scl: str = "scl") -> DataFrame:
    """``by``, bad_ratio: percentage of bad pixels among all."""
    return pixels.groupBy(*by).agg(bad_percent(F.col(scl)).alias("bad_ratio"))


def class_ring(near: DataFrame, by: list[str], classes: list[int], step: float = 10.0, limit: float = 100.0, scl: str = "scl") -> DataFrame:
    """``by``, ring: the smallest multiple of ``step`` within which a pixel of ``classes`` lies outside."""
    r = F.greatest(F.lit(step), F.ceil(F.col("dist") / step) * step)
    return near.filter((F.col("dist") > 0) & (F.col("dist") <= limit) & F.col(scl).isin(*classes)).groupBy(*by).agg(F.min(r).cast("double").alias("ring"))


def nearby_mean(near: DataFrame, rings: DataFrame, by: list[str], all_of: DataFrame, value: str = "ndvi", scl: str = "scl") -> DataFrame:
    """``by``, mean of vegetation within the ring found by ``class_ring``; 0 where there is none."""
    within = near.filter((F.col("dist") > 0) & (F.col(scl) == VEGETATION)).join(rings, by).filter("dist <= ring")
    return all_of.select(*by).distinct().join(within.groupBy(*by).agg(F.avg(value).alias("mean")), by, "left").select(*by, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def mean_radar(pixels: DataFrame, by: list[str], vv: str = "vv", vh: str = "vh") -> DataFrame:
    """``by``, vv, vh: means; both null if either band has no value."""
    both = (F.count(vv) > 0) & (F.count(vh) > 0)
    return pixels.groupBy(*by).agg(F.when(both, F.avg(vv)).alias("vv"), F.when(both, F.avg(vh)).alias("vh"))


def overlap_shares(windows: DataFrame, annotations: DataFrame, group: list[str], window: Column, key: str = "id", rings: str = "rings", cell: float = 1280.0) -> DataFrame:
    """Windows with each annotation whose extent meets theirs, and ``share``: the part of the
    annotation's own area inside the window. ``window`` is a struct minx, miny, maxx, maxy.

    Null where the annotation has no area. Cells with very many windows are salted.
    """
    cells = lambda b: (F.sequence(F.floor(b["minx"] / cell), F.floor(b["maxx"] / cell)), F.sequence(F.floor(b["miny"] / cell), F.floor(b["maxy"] / cell)))
    a = annotations.select(*group, F.col(key).alias("ann_id"), G.signed_rings(F.col(rings)).alias("_rings"), G.bounding_box(F.col(rings)).alias("_a")).filter("_a.minx is not null")
    a = a.withColumn("_area", G.area_in_box(F.col("_rings")))
    cx, cy = cells(F.col("_a"))
    a = a.withColumn("_cx", F.explode(cx)).withColumn("_cy", F.explode(cy))
    b = windows.withColumn("_w", window)
    cx, cy = cells(F.col("_w"))
    b = b.withColumn("_cx", F.explode(cx)).withColumn("_cy", F.explode(cy))
    # of the cells that both meet in, the first one is taken
    first = (F.col("_cx") == F.floor(F.greatest("_a.minx", "_w.minx") / cell)) & (F.col("_cy") == F.floor(F.greatest("_a.miny", "_w.miny") / cell))
    met = salted_join(b, a, [*group, "_cx", "_cy"], F.struct("_w")).filter("_a.minx <= _w.maxx and _a.maxx >= _w.minx and _a.miny <= _w.maxy and _a.maxy >= _w.miny").filter(first)
    share = F.when(F.col("_area") > 0, G.area_in_box(F.col("_rings"), F.col("_w")) / F.col("_area"))
    return met.withColumn("share", share).drop("_cx", "_cy", "_rings", "_area", "_a", "_w")


def rectangle_mask(pixels: DataFrame, boxes: DataFrame, group: list[str]) -> DataFrame:
    """Pixels within annotation extents (minx, miny, maxx, maxy); adds ``ann_id``."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy")))
    return pixels_in(pixels, boxes.select(*group, "id", ring.alias("rings")).dropna(), group)
