"""Polygon predicates over ring arrays as expressions, plus exact clipping and projections.

Rings follow the even-odd rule, so holes and several pieces need nothing special. Open rings are
closed. Vertices with null or NaN are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def edges(rings: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of all rings, closed."""
    ok = lambda v: v.isNotNull() & v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"])

    def ring(r: Column) -> Column:
        clean = F.filter(r, ok)
        moved = F.concat(F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1))), F.slice(clean, 1, 1))
        return F.zip_with(clean, moved, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), ring))


def contains(edge: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside: an upward ray meets an odd number of edges, half-open in x."""
    def crosses(e: Column) -> Column:
        inx = ((e["ax"] <= x) & (x < e["bx"])) | ((e["bx"] <= x) & (x < e["ax"]))
        return inx & (e["ay"] + (e["by"] - e["ay"]) * ((x - e["ax"]) / F.nullif(e["bx"] - e["ax"], F.lit(0.0))) <= y)

    return F.size(F.filter(edge, crosses)) % 2 == 1


def edge_distance2(edge: Column, x: Column, y: Column) -> Column:
    """Smallest squared distance of the point to any edge."""
    def one(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        t = ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
        px, py = e["ax"] + t * dx - x, e["ay"] + t * dy - y
        return px * px + py * py

    return F.array_min(F.transform(edge, one))


def distance(edge: Column, x: Column, y: Column) -> Column:
    """Distance to the polygon, 0 inside; the disc of a buffer, without chords."""
    return F.when(contains(edge, x, y), F.lit(0.0)).otherwise(F.sqrt(edge_distance2(edge, x, y)))


def touches_square(edge: Column, x: Column, y: Column, half: float) -> Column:
    """Whether the square around the point meets the polygon: the all-touched rule.

    An edge meets the square if its part within the square's x and y ranges is not empty
    (Liang-Barsky); a polygon around or within the square is met by centre or vertex.
    """
    def meets(e: Column) -> Column:
        lo, hi = F.lit(0.0), F.lit(1.0)
        fine = F.lit(True)
        for a, b, c in (("ax", "bx", x), ("ay", "by", y)):
            d = e[b] - e[a]
            p, q = (c - half - e[a]) / F.nullif(d, F.lit(0.0)), (c + half - e[a]) / F.nullif(d, F.lit(0.0))
            fine = fine & F.when(d == 0, F.abs(e[a] - c) <= half).otherwise(F.lit(True))
            lo = F.greatest(lo, F.least(p, q))
            hi = F.least(hi, F.greatest(p, q))
        return fine & (lo <= hi)

    return contains(edge, x, y) | F.exists(edge, meets)


def square_distance2(edge: Column, x: Column, y: Column, half: float) -> Column:
    """Smallest squared distance of any edge to the square around the point, where no edge meets it.

    Two shapes that do not meet are nearest at a corner of one of them.
    """
    corners = [edge_distance2(edge, x + sx * half, y + sy * half) for sx in (-1, 1) for sy in (-1, 1)]
    off = lambda c, m: F.greatest(F.abs(c - m) - half, F.lit(0.0))
    ends = F.array_min(F.transform(edge, lambda e: off(e["ax"], x) * off(e["ax"], x) + off(e["ay"], y) * off(e["ay"], y)))
    return F.least(ends, *corners)


def bounding_box(rings: Column, buffer: float = 0.0) -> Column:
    """minx, miny, maxx, maxy of all vertices, widened by ``buffer``; nulls without vertices."""
    flat = F.flatten(F.filter(rings, lambda r: r.isNotNull()))
    xs, ys = F.filter(F.transform(flat, lambda v: v["x"]), lambda c: ~F.isnan(c)), F.filter(F.transform(flat, lambda v: v["y"]), lambda c: ~F.isnan(c))
    return F.struct(
        (F.array_min(xs) - buffer).alias("minx"), (F.array_min(ys) - buffer).alias("miny"), (F.array_max(xs) + buffer).alias("maxx"), (F.array_max(ys) + buffer).alias("maxy")
    )


def repair(rings: Column) -> Column:
    """Closed rings of three vertices or more; null if none is left.

    Vertices with null or NaN go, repeated neighbours go, open rings are closed. Self-crossing
    rings keep their vertices; the even-odd rule gives them a defined inside.
    """
    ok = lambda v: v.isNotNull() & v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"])

    def ring(r: Column) -> Column:
        c = F.filter(r, ok)
        c = F.filter(c, lambda v, i: (i == 0) | (v != F.get(c, i - 1)))
        return F.when(F.get(c, F.lit(0)) == F.element_at(c, -1), c).otherwise(F.concat(c, F.slice(c, 1, 1)))

    kept = F.filter(F.transform(F.filter(rings, lambda r: F.size(F.filter(r, ok)) >= 3), ring), lambda r: F.size(r) >= 4)
    return F.when(F.size(kept) > 0, kept)


def signed_rings(rings: Column) -> Column:
    """array<struct<sign, edges>>: each ring's edges, the sign -1 for a ring inside an odd number of
    others (a hole). Rings of fewer than three vertices are left out."""
    each = F.filter(F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: edges(F.array(r))), lambda e: F.size(e) >= 3)

    def sign(e: Column, k: Column) -> Column:
        around = F.filter(each, lambda o, m: (m != k) & contains(o, e[0]["ax"], e[0]["ay"]))
        return F.when(F.size(around) % 2 == 1, -1.0).otherwise(1.0)

    return F.transform(each, lambda e, k: F.struct(sign(e, k).alias("sign"), e.alias("edges")))


def area_in_box(signed: Column, box: Column | None = None) -> Column:
    """Area of the rings of ``signed_rings`` within ``box`` (minx, miny, maxx, maxy), or of all of it.

    A ring's area is the sum over its edges of the integral of their height, cut to the box: for an
    edge from x0 to x1 within the box, of y held between miny and maxy, which is a difference of
    squares. No vertex is made, so rings of any shape and size are one pass over their edges.
    """
    def edge(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        if box is None:
            return dx * ((e["ay"] - base) + (e["by"] - base)) / 2
        hold = lambda c: F.greatest(box["minx"], F.least(box["maxx"], c))
        x0, x1 = hold(e["ax"]), hold(e["bx"])
        slope = dy / F.nullif(dx, F.lit(0.0))
        y0, y1 = e["ay"] + (x0 - e["ax"]) * slope - box["miny"], e["ay"] + (x1 - e["ax"]) * slope - box["miny"]
        high = box["maxy"] - box["miny"]
        # integral of the held height up to y, from the box's lower side
        upto = lambda y: F.when(y <= 0, 0.0).when(y <= high, y * y / 2).otherwise(high * high / 2 + high * (y - high))
        level = F.greatest(F.lit(0.0), F.least(high, (y0 + y1) / 2))
        return F.when(x0 == x1, 0.0).otherwise((x1 - x0) * F.when(F.abs(y1 - y0) < 1e-9, level).otherwise((upto(y1) - upto(y0)) / (y1 - y0)))

    base = signed[0]["edges"][0]["ay"]  # large coordinates would cost digits
    one = lambda r: r["sign"] * F.abs(F.aggregate(r["edges"], F.lit(0.0), lambda s, e: s + F.coalesce(edge(e), F.lit(0.0))))
    return F.aggregate(signed, F.lit(0.0), lambda s, r: s + one(r))


# WGS 84 ellipsoid and the scale of the UTM central meridian.
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the third order.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """Longitude and latitude in degrees (WGS 84) to UTM metres, struct x, y."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda c: F.log((1 + c) / (1 - c)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + _K0 * _RADIUS * east).alias("x"), ((10000000 if south else 0) + _K0 * _RADIUS * north).alias("y"))


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> Column:
    """UTM metres to longitude and latitude in degrees (WGS 84), struct x, y."""
    xi, eta = (y - (10000000 if south else 0)) / (_K0 * _RADIUS), (x - 500000) / (_K0 * _RADIUS)
    p, q = xi, eta
    for j, b in enumerate(_BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.lit(math.radians(zone * 6 - 183)) + F.atan2(F.sinh(q), F.cos(p))
    return F.struct(F.degrees(lon).alias("x"), F.degrees(lat).alias("y"))


def utm_zone(code: str) -> tuple[int, bool]:
    """Zone and hemisphere of an EPSG code 326xx or 327xx; others are refused."""
    if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return int(code[3:]), code[2] == "7"
    raise ValueError(f"only UTM zones on WGS 84 and EPSG 4326 are supported, not {code}")


def reproject(rings: Column, source: str, target: str) -> Column:
    """Rings from one reference system to another, by EPSG code; null stays null."""
    if source == target:
        return rings
    there = (lambda v: v) if source == "4326" else (lambda v: from_utm(v["x"], v["y"], *utm_zone(source)))
    back = (lambda v: v) if target == "4326" else (lambda v: to_utm(v["x"], v["y"], *utm_zone(target)))
    return F.transform(rings, lambda r: F.transform(F.transform(r, there), back))
