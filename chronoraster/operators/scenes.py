"""Scene catalogues: cleaning, ranges, selection for time series, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import band_rank
from ..skew import bucketed_rank
from .timeseries import nearest_date


def distinct_scenes(scenes: DataFrame, key: str = "scene_id") -> DataFrame:
    """One row per scene; of rows listed twice the first in the order of their columns stays.

    Rows without key are dropped. The choice is an aggregate, so it combines before the shuffle.
    """
    rest = [c for c, t in scenes.dtypes if c != key]
    order = F.struct(*[F.to_json(F.struct(c)).alias(f"o{i}") for i, c in enumerate(rest)])
    return scenes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*").select(scenes.columns)


def date_range(scenes: DataFrame, by: list[str], date: str = "scene_date") -> DataFrame:
    """``by``, first, last, n of the scenes with a date."""
    return scenes.filter(F.col(date).isNotNull()).groupBy(*by).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("n"))


def add_scenes(scenes: DataFrame, more: DataFrame) -> DataFrame:
    """Both catalogues as one; columns that one lacks are null there."""
    return scenes.unionByName(more, allowMissingColumns=True)


def remove_scene(scenes: DataFrame, position: int, by: list[str], date: str = "scene_date", key: str = "scene_id") -> DataFrame:
    """Each group's scenes without the one at ``position`` (from 0) in date order."""
    month = F.date_format(F.coalesce(F.col(date), F.lit("9999-12-31").cast("date")), "yyyy-MM")
    ranked = bucketed_rank(scenes, by, month, [F.col(date).asc_nulls_last(), F.col(key)], "_rn")
    return ranked.filter(F.col("_rn") != position + 1).select(scenes.columns)


def bands_of(scenes: DataFrame, key: str = "scene_id", paths: str = "band_paths") -> DataFrame:
    """key, band, path, rank: one row per band of a scene, in band order when sorted by rank."""
    return scenes.select(key, F.explode(paths).alias("band", "path")).withColumn("rank", band_rank(F.col("band")))


def band_path(band: str, paths: str = "band_paths"):
    """Path of one band as an expression; null if the scene lacks it."""
    return F.try_element_at(F.col(paths), F.lit(band))


def incomplete_scenes(scenes: DataFrame, needed: list[str], key: str = "scene_id", paths: str = "band_paths") -> DataFrame:
    """key, missing: scenes that lack some of the ``needed`` bands."""
    lacking = F.array_except(F.array(*[F.lit(b) for b in needed]), F.coalesce(F.map_keys(paths), F.array().cast("array<string>")))
    return scenes.select(key, lacking.alias("missing")).filter(F.size("missing") > 0)


def band_by_resolution(bands: DataFrame, resolution: int, key: str = "scene_id", x_res: str = "x_res") -> DataFrame:
    """key, band: the first band in band order with this x resolution; none, no row."""
    order = F.struct(band_rank(F.col("band")).alias("r"), F.col("band").alias("b"))
    return bands.filter(F.col(x_res) == resolution).groupBy(key).agg(F.min(order).alias("_m")).select(key, F.col("_m.b").alias("band"))


def _padded(chosen: DataFrame, ends: DataFrame, total: int, by: list[str], key: str, date: str) -> DataFrame:
    n = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    need = ends.join(n, by, "left").withColumn("_m", F.greatest(F.lit(total) - F.coalesce("_n", F.lit(0)), F.lit(0)).cast("int"))
    front = F.floor(F.col("_m") / 2).cast("int")
    copies = lambda c, k: F.when(k > 0, F.array_repeat(F.col(c), k)).otherwise(F.array().cast("array<struct<d:date,k:string>>"))
    extra = need.select(*by, F.explode(F.concat(copies("_first", front), copies("_last", F.col("_m") - front))).alias("_s"))
    return chosen.select(*by, key, date, F.lit(False).alias("padding")).unionByName(extra.select(*by, F.col("_s.k").alias(key), F.col("_s.d").alias(date), F.lit(True).alias("padding")))


def _ends(scenes: DataFrame, by: list[str], key: str, date: str) -> DataFrame:
    s = F.struct(F.col(date).alias("d"), F.col(key).cast("string").alias("k"))
    return scenes.groupBy(*by).agg(F.min(s).alias("_first"), F.max(s).alias("_last"))


def pad_scenes(chosen: DataFrame, scenes: DataFrame, total: int, by: list[str], key: str = "scene_id", date: str = "scene_date") -> DataFrame:
    """``chosen`` filled up to ``total`` per group: half of what lacks (cut) are copies of the
    group's first scene, the rest of its last; ``padding`` marks them."""
    return _padded(chosen, _ends(scenes, by, key, date), total, by, key, date)


def scenes_per_month(scenes: DataFrame, ratios: DataFrame, total: int, by: list[str], key: str = "scene_id", date: str = "scene_date", seed: int = 42) -> DataFrame:
    """``by``, key, date, padding: a time series of ``total`` scenes per group.

    Of each month the max(total div months, 1) scenes with the lowest bad ratio (unknown ratios
    last), then others in hashed order up to ``total``, then padding. A group with more months than
    ``total`` keeps one scene per month. Scenes without date are passed over.
    """
    known = scenes.filter(F.col(date).isNotNull()).join(ratios.select(key, "bad_ratio"), key, "left").select(*by, key, date, "bad_ratio")
    month = F.trunc(F.col(date), "month")
    k = known.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.lit(total) / F.countDistinct(month))).alias("_k"))
    w = Window.partitionBy(*by, "_month").orderBy(F.col("bad_ratio").asc_nulls_last(), F.col(date), F.col(key))
    ranked = known.join(k, by).withColumn("_month", month).withColumn("_rn", F.row_number().over(w))
    best = ranked.filter("_rn <= _k").select(*by, key, date)
    n = best.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    h = ranked.filter("_rn > _k").withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))))
    others = bucketed_rank(h, by, F.substring("_h", 1, 2), [F.col("_h"), F.col(key)], "_r").join(n, by)
    more = others.filter(F.col("_r") <= total - F.col("_n")).select(*by, key, date)
    return _padded(best.unionByName(more), _ends(known, by, key, date), total, by, key, date)


def scenes_around_event(events: DataFrame, scenes: DataFrame, total: int, group: list[str], event_key: str = "id", pre: str = "pre_date", post: str = "post_date", key: str = "scene_id", date: str = "scene_date", seed: int = 42) -> DataFrame:
    """event_key, role, key, date: per event the scenes nearest to its two dates, then others of
    its group in hashed order up to ``total``, then padding as in ``pad_scenes`` if the group has
    fewer: copies of its first and last scene.

    A chosen scene is not chosen again, except as padding. Events without dates or scenes have no rows. Extras come
    from each group's ``total`` + 2 first scenes in hashed order, so an event meets a bounded number.
    """
    ev = events.filter(F.col(event_key).isNotNull()).select(F.col(event_key).alias("_e"), *group, F.col(pre).alias("_pre"), F.col(post).alias("_post")).dropna(subset=["_pre", "_post"])
    s = scenes.filter(F.col(date).isNotNull())
    both = nearest_date(ev, s, group, "_pre", date, key).withColumnsRenamed({f"nearest_{key}": "_a", "nearest_date": "_ad"})
    both = nearest_date(both, s, group, "_post", date, key).withColumnsRenamed({f"nearest_{key}": "_b", "nearest_date": "_bd"}).filter("_a is not null")
    pick = lambda role, k, d: F.struct(F.lit(role).alias("role"), F.col(k).alias(key), F.col(d).alias(date))
    named = both.select("_e", F.explode(F.when(F.col("_a") == F.col("_b"), F.array(pick("pre", "_a", "_ad"))).otherwise(F.array(pick("pre", "_a", "_ad"), pick("post", "_b", "_bd")))).alias("_p"))
    h = s.select(*group, key, date).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))))
    first = bucketed_rank(h, group, F.substring("_h", 1, 2), [F.col("_h"), F.col(key)], "_r").filter(F.col("_r") <= total + 2)
    extra = both.join(first, group).filter((F.col(key) != F.col("_a")) & (F.col(key) != F.col("_b")))
    w = Window.partitionBy("_e").orderBy("_r")
    room = F.lit(total) - F.when(F.col("_a") == F.col("_b"), 1).otherwise(2)
    extra = extra.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= room).select("_e", F.lit("extra").alias("role"), key, date)
    chosen = named.select("_e", "_p.*").unionByName(extra)
    lacking = both.select("_e", *group).join(_ends(s, group, key, date), group)
    padding = _padded(chosen.select("_e", key, date), lacking, total, ["_e"], key, date).filter("padding")
    return chosen.unionByName(padding.select("_e", F.lit("padding").alias("role"), key, date)).withColumnRenamed("_e", event_key)
