"""Scene catalogues from folders of band files. Only names are read, never file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N


def band_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every .tif below ``root``; an empty table if there is none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(root).select("path")


def _folder(path):
    parts = F.split(path, "/")
    return F.element_at(parts, -2), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def optical_scenes(files: DataFrame, with_indices: bool = False) -> DataFrame:
    """scene_id, scene_name, scene_date, scene_path, band_paths, bad_date: one row per folder.

    Files without a band in their name are passed over. The name comes from the first file in
    name order; a folder whose name holds no date stays with a null date and ``bad_date``.
    """
    f = files.withColumn("band", N.s2_band(F.col("path"), with_indices)).filter("band is not null")
    name, path = _folder(F.col("path"))
    per = f.select(name.alias("scene_id"), path.alias("scene_path"), "band", "path").groupBy("scene_id", "scene_path").agg(F.min("path").alias("_first"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("band", "path")))).alias("band_paths"))
    scene = N.s2_scene_name(N.stem(F.col("_first")))
    out = per.select("scene_id", scene.alias("scene_name"), N.s2_scene_date(scene).alias("scene_date"), "scene_path", "band_paths")
    return out.withColumn("bad_date", F.col("scene_date").isNull())


def radar_scenes(files: DataFrame, upper: bool = True) -> DataFrame:
    """Like ``optical_scenes`` for radar folders, with ``orbit``; null where the name has neither."""
    f = files.withColumn("band", N.s1_band(N.base_name(F.col("path")), upper)).filter("band is not null")
    name, path = _folder(F.col("path"))
    per = f.select(name.alias("scene_id"), path.alias("scene_path"), "band", "path").groupBy("scene_id", "scene_path").agg(F.min("path").alias("_first"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("band", "path")))).alias("band_paths"))
    stem = N.stem(F.col("_first"))
    out = per.select("scene_id", N.s1_scene_name(stem).alias("scene_name"), N.s1_scene_date(stem).alias("scene_date"), N.orbit(stem).alias("orbit"), "scene_path", "band_paths")
    return out.withColumn("bad_date", F.col("scene_date").isNull())


def mask_file(files: DataFrame) -> DataFrame:
    """path of the first file, in name order, with "mask" in its name; no row without one."""
    return files.filter(F.contains(N.base_name(F.col("path")), F.lit("mask"))).orderBy("path").limit(1)
