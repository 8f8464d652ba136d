"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chronoraster", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach.

    Only where it is unset, as in tests on one machine, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        if "CHRONORASTER_SCRATCH" not in os.environ:
            os.environ["CHRONORASTER_SCRATCH"] = tempfile.mkdtemp(prefix="chronoraster-")
            atexit.register(shutil.rmtree, os.environ["CHRONORASTER_SCRATCH"], ignore_errors=True)
        found = os.environ["CHRONORASTER_SCRATCH"]
    return found.rstrip("/")


def keep(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and unlike a
    checkpointed RDD the table is compressed and columnar. ``drop_kept`` removes it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(spark: SparkSession) -> None:
    """Delete all tables this application kept. Results that are not yet written need them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
