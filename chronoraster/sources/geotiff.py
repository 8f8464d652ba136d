"""GeoTIFF as a data source: blocks of bands as rows.

``spark.read.format("geotiff").load(glob)`` after ``register(spark)``. The driver only lists names and
sizes; a large file is cut into slices, and a task reads the header and seeks to the blocks of its
own slice. Options: ``bands`` (descriptions, comma separated) and ``window`` (col,row,width,height)
restrict what is read, blocks outside are not touched; ``slice_mb`` sets the slices' size. Strips and tiles, no compression, deflate and
LZW, horizontal differencing, both byte orders, classic and big files; anything else is refused
with a message. Paths must be readable by the executors as files; ``decode_files`` takes the
content from Spark's binaryFile source instead and so reads any file system Spark knows.
"""

from __future__ import annotations

import glob
import io
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "path string, band int, description string, time string, block_row int, block_col int, row_off int, col_off int, w int, h int, width int, height int, "
    "transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, epsg int, nodata double, values array<double>"
)
ARROW = pa.schema([
    *[pa.field(n, k) for n, k in (("path", pa.string()), ("band", pa.int32()), ("description", pa.string()), ("time", pa.string()))],
    *[pa.field(n, pa.int32()) for n in ("block_row", "block_col", "row_off", "col_off", "w", "h", "width", "height")],
    pa.field("transform", pa.struct([(k, pa.float64()) for k in "abcdef"])), pa.field("epsg", pa.int32()), pa.field("nodata", pa.float64()), pa.field("values", pa.list_(pa.float64())),
])
# TIFF field types (size, struct code) and tag numbers.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048


class Tiff:
    """Header of the first image of a file and its blocks."""

    def __init__(self, f: BinaryIO) -> None:
        self.f = f
        head = f.read(16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        magic = struct.unpack(self.order + "H", head[2:4])[0]
        if magic == 42:
            n_code, o_code, entry, at = "H", "I", 12, struct.unpack(self.order + "I", head[4:8])[0]
        elif magic == 43:
            n_code, o_code, entry, at = "Q", "Q", 20, struct.unpack(self.order + "Q", head[8:16])[0]
        else:
            raise ValueError("not a TIFF file")
        f.seek(at)
        n = struct.unpack(self.order + n_code, f.read(struct.calcsize(n_code)))[0]
        raw = f.read(n * entry)
        self.tags: dict[int, Any] = {}
        inline = struct.calcsize(o_code)
        for k in range(n):
            e = raw[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(self.order + "HH", e[:4])
            count = struct.unpack(self.order + o_code, e[4 : 4 + inline])[0]
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            data = e[4 + inline : 4 + 2 * inline]
            if size * count > inline:
                f.seek(struct.unpack(self.order + o_code, data)[0])
                data = f.read(size * count)
            data = data[: size * count]
            if code == "s":
                self.tags[tag] = data.split(b"\0")[0].decode("latin-1")
            else:
                self.tags[tag] = struct.unpack(self.order + code * count, data) if len(code) == 1 else struct.unpack(self.order + code * count, data)
        t = self.tags
        self.width, self.height, self.samples = t[WIDTH][0], t[LENGTH][0], t.get(SAMPLES, (1,))[0]
        self.tiled = TILE_WIDTH in t
        self.bw, self.bh = (t[TILE_WIDTH][0], t[TILE_LENGTH][0]) if self.tiled else (self.width, min(self.height, t.get(ROWS_PER_STRIP, (self.height,))[0]))
        self.across, self.down = -(-self.width // self.bw), -(-self.height // self.bh)
        self.planar = t.get(PLANAR, (1,))[0] == 2
        bits = t.get(BITS, (1,))
        form = t.get(SAMPLE_FORMAT, (1,))[0]
        if len(set(bits)) != 1 or bits[0] not in (8, 16, 32, 64) or form not in (1, 2, 3):
            raise ValueError(f"sample layout not supported: {bits} bits, format {form}")
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[form] + str(bits[0] // 8))
        self.compression, self.predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
        if self.compression not in (1, 5, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not supported")
        self.blocks = self.across * self.down * (self.samples if self.planar else 1)

    @property
    def transform(self) -> tuple[float, ...] | None:
        t = self.tags
        if TRANSFORMATION in t:
            m = t[TRANSFORMATION]
            return (m[0], m[1], m[3], m[4], m[5], m[7])
        if PIXEL_SCALE in t and TIE_POINT in t:
            (sx, sy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIE_POINT]
            return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        return None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        return found.get(PROJECTED_KEY, found.get(GEOGRAPHIC_KEY))

    @property
    def nodata(self) -> float | None:
        try:
            return float(self.tags[NODATA])
        except (KeyError, ValueError):
            return None

    def description(self, band: int) -> str | None:
        m = re.search(rf'<Item name="DESCRIPTION" sample="{band}"[^>]*>([^<]*)<', self.tags.get(METADATA, ""))
        return m.group(1) if m else None

    @property
    def time(self) -> str | None:
        m = re.search(r'<Item name="time"[^>]*>([^<]*)<', self.tags.get(METADATA, ""), re.I)
        return m.group(1) if m else None

    def block(self, k: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """band (from 1), block row, block column, values of each band of block ``k``."""
        offsets, sizes = (self.tags[TILE_OFFSETS], self.tags[TILE_BYTES]) if self.tiled else (self.tags[STRIP_OFFSETS], self.tags[STRIP_BYTES])
        plane, place = divmod(k, self.across * self.down)
        r, c = divmod(place, self.across)
        h = self.bh if self.tiled else min(self.bh, self.height - r * self.bh)
        per = 1 if self.planar else self.samples
        self.f.seek(offsets[k])
        raw = self.f.read(sizes[k])
        if self.compression == 5:
            raw = lzw(raw)
        elif self.compression != 1:
            raw = zlib.decompress(raw)
        a = np.frombuffer(raw, self.dtype, h * self.bw * per).reshape(h, self.bw, per)
        if self.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=self.dtype.newbyteorder("="))
        a = a[: self.height - r * self.bh, : self.width - c * self.bw]
        for s in range(per):
            yield plane + 1 if self.planar else s + 1, r, c, a[:, :, s]


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widths changing one code early."""
    out, table = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""]
    bits = acc = 0
    width, prev = 9, None
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prev = table[:258], 9, None
            continue
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev is not None:
            table.append(prev + entry[:1])
        prev = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def rows(path: str, f: BinaryIO, part: int = 0, parts: int = 1, bands: set[str] | None = None, window: tuple[int, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """A batch of SCHEMA per band and block of slice ``part``; no-data and NaN become null."""
    t = Tiff(f)
    place = t.transform
    for k in range(part * t.blocks // parts, (part + 1) * t.blocks // parts):
        r, c = divmod(k % (t.across * t.down), t.across)
        if window and (c * t.bw >= window[0] + window[2] or (c + 1) * t.bw <= window[0] or r * t.bh >= window[1] + window[3] or (r + 1) * t.bh <= window[1]):
            continue
        if bands and t.planar and t.description(k // (t.across * t.down) + 1) not in bands:
            continue
        for band, r, c, a in t.block(k):
            name = t.description(band)
            if bands and name not in bands:
                continue
            row, col = r * t.bh, c * t.bw
            if window:
                top, left = max(0, window[1] - row), max(0, window[0] - col)
                a = a[top : window[1] + window[3] - row, left : window[0] + window[2] - col]
                row, col = row + top, col + left
            v = a.astype(float).ravel()
            gone = np.isnan(v) | (v == t.nodata if t.nodata is not None else False)
            values = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.float64(), mask=np.broadcast_to(gone, v.shape)))
            one = [path, band, name, t.time, r, c, row, col, a.shape[1], a.shape[0], t.width, t.height, dict(zip("abcdef", place)) if place else None, t.epsg, t.nodata]
            yield pa.RecordBatch.from_arrays([*[pa.array([x], kind) for x, kind in zip(one, ARROW.types)], values], schema=ARROW)


class Slice(InputPartition):
    def __init__(self, path: str, part: int, parts: int) -> None:
        self.path, self.part, self.parts = path, part, parts


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern = options.get("path", "")
        self.slice = float(options.get("slice_mb", "64")) * 1e6
        self.bands = {b.strip() for b in options["bands"].split(",")} if options.get("bands") else None
        self.window = tuple(int(x) for x in options["window"].split(",")) if options.get("window") else None

    def partitions(self) -> list[Slice]:
        out = []
        for p in sorted(glob.glob(self.pattern.removeprefix("file:"), recursive=True)):
            n = max(1, math.ceil(os.path.getsize(p) / self.slice))
            out += [Slice(p, k, n) for k in range(n)]
        return out or [Slice("", 0, 1)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.path:
            with open(part.path, "rb") as f:
                yield from rows(part.path, f, part.part, part.parts, self.bands, self.window)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def decode_files(files: DataFrame, bands: Sequence[str] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The same rows from Spark's binaryFile source (path, content), which lists files in its own way
    and reads any file system; a file per row must fit a task."""
    wanted = set(bands) if bands else None

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                yield from rows(path, io.BytesIO(content), bands=wanted, window=window)

    return files.select("path", "content").mapInArrow(decode, SCHEMA)


def encode(bands: list[np.ndarray], transform: tuple[float, ...], epsg: int, descriptions: list[str], time: str = "", nodata: float | None = None, tile: int = 0, deflate: bool = True, predictor: bool = False) -> bytes:
    """A little-endian classic GeoTIFF with band descriptions and a time tag, plane by plane."""
    h, w = bands[0].shape
    dtype = bands[0].dtype.newbyteorder("<")
    bh, bw = (tile, tile) if tile else (max(1, min(h, 8192 // max(1, w * dtype.itemsize) or 1)), w)
    blocks = []
    for b in bands:
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                part = b[r : r + bh, c : c + bw]
                if tile:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1])))
                if predictor:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                raw = np.ascontiguousarray(part, dtype).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{d}</Item>' for k, d in enumerate(descriptions, 1))
    meta = f'<GDALMetadata><Item name="time">{time}</Item>{items}</GDALMetadata>'
    n = len(bands)
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (w,)), LENGTH: (4, (h,)), BITS: (3, (dtype.itemsize * 8,) * n), COMPRESSION: (3, (8 if deflate else 1,)), 262: (3, (1,)), SAMPLES: (3, (n,)), PLANAR: (3, (2,)),
        PREDICTOR: (3, (2 if predictor else 1,)), SAMPLE_FORMAT: (3, (kind,) * n), PIXEL_SCALE: (12, (transform[0], -transform[4], 0.0)), TIE_POINT: (12, (0.0, 0.0, 0.0, transform[2], transform[5], 0.0)),
        GEO_KEYS: (3, (1, 1, 0, 1, PROJECTED_KEY, 0, 1, epsg)), METADATA: (2, meta.encode("latin-1") + b"\0"),
    }
    if nodata is not None:
        tags[NODATA] = (2, f"{nodata:g}".encode() + b"\0")
    if tile:
        tags |= {TILE_WIDTH: (4, (tile,)), TILE_LENGTH: (4, (tile,))}
    else:
        tags[ROWS_PER_STRIP] = (4, (bh,))
    where, sizes = (TILE_OFFSETS, TILE_BYTES) if tile else (STRIP_OFFSETS, STRIP_BYTES)
    tags |= {where: (4, (0,) * len(blocks)), sizes: (4, tuple(map(len, blocks)))}

    def pack(kind: int, v) -> bytes:
        return v if isinstance(v, bytes) else struct.pack("<" + TYPES[kind][1] * len(v), *v)

    start = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(pack(*tv)) + len(pack(*tv)) % 2 for tv in tags.values() if len(pack(*tv)) > 4)
    at, offs = start + extra, []
    for b in blocks:
        offs.append(at)
        at += len(b)
    tags[where] = (4, tuple(offs))
    out, tail, pos = bytearray(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags))), bytearray(), start
    for tag in sorted(tags):
        kind, v = tags[tag]
        data = pack(kind, v)
        out += struct.pack("<HHI", tag, kind, len(v) if not isinstance(v, bytes) else len(v))
        if len(data) <= 4:
            out += data.ljust(4, b"\0")
        else:
            out += struct.pack("<I", pos)
            data += b"\0" * (len(data) % 2)
            tail += data
            pos += len(data)
    return bytes(out + struct.pack("<I", 0) + tail + b"".join(blocks))
