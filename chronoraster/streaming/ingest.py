"""Incremental ingest of readings: an addition to the batch operators, not a substitute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import usable
from ..functions.predicates import is_bad

READINGS = "rec_id bigint, id bigint, cube_name string, scene_id string, obs_time timestamp_ntz, ndvi double, ndvi_undist double, scl smallint, ingested_at timestamp_ntz"


def readings(spark: SparkSession, path: str, late: str = "30 days", files_per_trigger: int = 100) -> DataFrame:
    """Readings as they arrive as Parquet files, with event time ``obs_time``; rows delivered again
    under the same rec_id within ``late`` come once."""
    s = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    timed = s.withColumns({c: F.col(c).cast("timestamp") for c in ("obs_time", "ingested_at")}).withWatermark("obs_time", late)
    return timed.dropDuplicatesWithinWatermark(["rec_id"])


def scene_quality(stream: DataFrame, period: str = "16 days") -> DataFrame:
    """cube_name, start, n, bad_percent, mean_ndvi per cube and window; sums combine map-side."""
    g = stream.groupBy(F.window("obs_time", period).alias("w"), "cube_name")
    bad = 100.0 * F.sum(F.when(is_bad(F.col("scl")), 1).otherwise(0)) / F.count(F.lit(1))
    out = g.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad_percent"), F.avg(usable("ndvi")).alias("mean_ndvi"))
    return out.select("cube_name", F.col("w.start").alias("start"), "n", "bad_percent", "mean_ndvi")
