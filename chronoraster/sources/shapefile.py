"""Shapefiles as a data source: a row per record, with rings and attributes.

``spark.read.format("shapefile").load(path)`` after ``register(spark)``. Record ranges come from
the .shx index, so tasks seek to their own records. Polygons (plain, Z and M) are read; null shapes
give null rings; other shapes are refused.
"""

from __future__ import annotations

import datetime
import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import repair

RINGS = "array<array<struct<x:double,y:double>>>"
# Shape types of null shapes and polygons.
NULL_SHAPE, POLYGONS = 0, (5, 15, 25)


def first_shapefile(folder: str) -> str:
    """The first .shp of a folder in name order; raises if there is none."""
    found = sorted(glob.glob(os.path.join(folder, "*.shp")))
    if not found:
        raise FileNotFoundError(f"no shapefile in {folder}")
    return found[0]


def _fields(path: str) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """Fields (name, type, length, decimals), number of records, header size, record size."""
    with open(os.path.splitext(path)[0] + ".dbf", "rb") as f:
        head = f.read(32)
        n, size, rec = struct.unpack("<IHH", head[4:12])
        out = []
        while (d := f.read(32))[:1] not in (b"\r", b""):
            out.append((d[:11].split(b"\0")[0].decode("latin-1"), chr(d[11]), d[16], d[17]))
    return out, n, size, rec


def _spark_type(kind: str, decimals: int) -> str:
    return {"N": "double" if decimals else "bigint", "F": "double", "D": "date", "L": "boolean"}.get(kind, "string")


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    s = raw.decode(encoding, "replace").strip().strip("\0")
    if not s or s.startswith("*"):
        return None
    try:
        if kind in "NF":
            return float(s) if decimals or kind == "F" else int(float(s))
        if kind == "D":
            return datetime.date(int(s[:4]), int(s[4:6]), int(s[6:8]))
    except ValueError:
        return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(s.upper())
    return s


class Records(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "").removeprefix("file:")
        self.per_task = int(options.get("records_per_task", "20000"))
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> list[Records]:
        n = max(0, (os.path.getsize(os.path.splitext(self.path)[0] + ".shx") - 100) // 8)
        return [Records(k, min(n, k + self.per_task)) for k in range(0, n, self.per_task)] or [Records(0, 0)]

    def read(self, part: Records) -> Iterator[tuple]:
        stem = os.path.splitext(self.path)[0]
        fields, n, size, rec = _fields(self.path)
        with open(stem + ".shx", "rb") as x, open(self.path, "rb") as shp, open(stem + ".dbf", "rb") as dbf:
            x.seek(100 + 8 * part.first)
            index = x.read(8 * (part.last - part.first))
            for k in range(part.first, part.last):
                at = struct.unpack(">i", index[8 * (k - part.first) : 8 * (k - part.first) + 4])[0] * 2
                shp.seek(at + 4)
                length = struct.unpack(">i", shp.read(4))[0] * 2
                rings = _polygon(shp.read(length))
                values: list = [None] * len(fields)
                if k < n:
                    dbf.seek(size + rec * k)
                    row = dbf.read(rec)
                    pos = 1
                    for i, (_, kind, width, dec) in enumerate(fields):
                        values[i] = _value(row[pos : pos + width], kind, dec, self.encoding)
                        pos += width
                yield (k, rings, *values)


def _polygon(body: bytes):
    kind = struct.unpack("<i", body[:4])[0]
    if kind == NULL_SHAPE:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} is not a polygon")
    parts, points = struct.unpack("<ii", body[36:44])
    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
    flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    return [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields, *_ = _fields(self.options.get("path", "").removeprefix("file:"))
        return f"record int, rings {RINGS}" + "".join(f", `{n}` {_spark_type(k, d)}" for n, k, _, d in fields)

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shapefile)


def crs_text(path: str) -> str | None:
    """Text of the .prj beside the shapefile; None without one."""
    try:
        with open(os.path.splitext(path)[0] + ".prj") as f:
            return f.read().strip() or None
    except FileNotFoundError:
        return None


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Records with repaired rings; records without geometry are dropped. Adds ``crs``."""
    register(spark)
    df = spark.read.format("shapefile").load(path)
    return df.withColumn("rings", repair(F.col("rings"))).filter("rings is not null").withColumn("crs", F.lit(crs_text(path)).cast("string"))


def write_shapefile(path: str, shapes: list[list[list[tuple[float, float]]] | None], fields: list[tuple[str, str, int, int]], values: list[tuple]) -> None:
    """A small polygon shapefile (.shp, .shx, .dbf), for exchange and tests."""
    shp, shx, at = bytearray(), bytearray(), 50
    for k, rings in enumerate(shapes):
        if rings is None:
            body = struct.pack("<i", NULL_SHAPE)
        else:
            pts = [p for r in rings for p in r]
            starts = [sum(len(r) for r in rings[:m]) for m in range(len(rings))]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        shx += struct.pack(">2i", at, len(body) // 2)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    stem = os.path.splitext(path)[0]
    with open(path, "wb") as f:
        f.write(head(len(shp)) + shp)
    with open(stem + ".shx", "wb") as f:
        f.write(head(len(shx)) + shx)
    rec = 1 + sum(w for *_, w, _ in fields)
    with open(stem + ".dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(values), 33 + 32 * len(fields), rec))
        for n, k, w, d in fields:
            f.write(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d))
        f.write(b"\r")
        for row in values:
            f.write(b" " + b"".join(("" if v is None else str(v)).encode()[:w].ljust(w) for v, (_, _, w, _) in zip(row, fields)))
        f.write(b"\x1a")
