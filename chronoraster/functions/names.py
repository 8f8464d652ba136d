"""What file and folder names say: band, name, date, orbit, rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name patterns of the scene layouts.
S2_BAND = r"(B\d+[A-Z]?|SCL)\.tif"
S2_BAND_WITH_INDICES = r"(B\d+[A-Z]?|SCL|NDVI|NDWI)\.tif"
S1_BAND = r"(vv|vh).*\.tif"
# Order of the optical bands; others come last.
BAND_RANK = {"B01": 1, "B02": 2, "B03": 3, "B04": 4, "B05": 5, "B06": 6, "B07": 7, "B08": 8, "B8A": 9, "B09": 10, "B10": 11, "B11": 12, "B12": 13, "SCL": 100}
# Ranks of the index layers in the older order by digits.
INDEX_RANK = {"SCL": 100, "NDWI": 101, "NDVI": 102}
LAST_RANK = 2147483647


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def s2_band(path: Column, with_indices: bool = False) -> Column:
    """Band id in an optical file path, null if none; case matters."""
    return _found(path, S2_BAND_WITH_INDICES if with_indices else S2_BAND)


def s1_band(path: Column, upper: bool = True) -> Column:
    """Polarisation in a radar file path, upper-cased by default; null if none."""
    got = _found(path, S1_BAND)
    return F.upper(got) if upper else got


def _lookup(key: Column, values: dict[str, int], other: Column) -> Column:
    out = F.lit(None)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, other)


def band_rank(band: Column) -> Column:
    """Sort rank by the explicit order; unknown and null bands rank last."""
    return _lookup(band, BAND_RANK, F.lit(LAST_RANK))


def band_digits_rank(band: Column) -> Column:
    """Sort rank by the digits in the name, so B8A ties with B08; index layers after all bands."""
    digits = F.regexp_extract(band, r"(\d+)", 1)
    return _lookup(band, INDEX_RANK, F.coalesce(F.when(digits != "", digits.cast("int")), F.lit(LAST_RANK)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def _tokens(name: Column) -> Column:
    return F.split(name, "_")


def s2_scene_name(file_stem: Column) -> Column:
    """The stem without its last two parts' band: all but the last token."""
    t = _tokens(file_stem)
    return F.array_join(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), "_")


def s2_scene_date(scene_name: Column) -> Column:
    """Date in the last token (yyyyMMdd); null if it is none."""
    return F.try_to_timestamp(F.element_at(_tokens(scene_name), -1), F.lit("yyyyMMdd")).cast("date")


def s1_scene_name(file_stem: Column) -> Column:
    """The stem without its last two tokens."""
    t = _tokens(file_stem)
    return F.array_join(F.slice(t, 1, F.greatest(F.size(t) - 2, F.lit(0))), "_")


def s1_scene_date(name: Column) -> Column:
    """The first eight digits in a row, as a date; null if there are none."""
    return F.try_to_timestamp(_found(name, r"(\d{8})"), F.lit("yyyyMMdd")).cast("date")


def s1_old_time(name: Column) -> Column:
    """Time in the fourth token after the index start of zero (``20170219t095846``)."""
    return F.try_to_timestamp(F.upper(F.get(_tokens(name), F.lit(4))), F.lit("yyyyMMdd'T'HHmmss"))


def orbit(name: Column) -> Column:
    """asc or dsc wherever it stands in the name; null if neither."""
    return F.when(F.contains(name, F.lit("asc")), "asc").when(F.contains(name, F.lit("dsc")), "dsc")


def is_number(name: Column) -> Column:
    """Whether the text reads as a number."""
    return F.coalesce(F.trim(name).try_cast("double").isNotNull(), F.lit(False))
