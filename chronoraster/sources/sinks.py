"""Parquet and JSON sinks, written only where nothing is yet unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, reset: bool = False) -> None:
    """Parquet, partitioned; an existing table stays as it is unless ``reset``.

    Rows are spread by the partition columns and a hash before the write, so a partition gets few
    files, and a large one several.
    """
    w = df
    if partition_by:
        w = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns) if not any(t.startswith("map") for _, t in df.dtypes) else F.lit(0), F.lit(4)))
    w.write.mode("overwrite" if reset else "ignore").partitionBy(*(partition_by or [])).parquet(path)


def write_patches(patches: DataFrame, path: str, reset: bool = False) -> None:
    """Patch arrays by band."""
    write_table(patches, path, ["band"], reset)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_signatures(signatures: DataFrame, path: str, reset: bool = False) -> None:
    """ann_id, signature (JSON text) as JSON lines."""
    signatures.select(F.to_json(F.struct(F.col("ann_id"), F.from_json("signature", "map<string,string>").alias("signature"))).alias("value")).write.mode("overwrite" if reset else "ignore").text(path)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """ann_id, date, band, mean; an empty table where nothing was written."""
    schema = "ann_id bigint, signature map<string,string>"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "ann_id bigint, date date, band string, mean double")
    rows = spark.read.schema(schema).json(path).select("ann_id", F.explode("signature").alias("day", "bands"))
    each = rows.select("ann_id", F.to_date("day", "yyyyMMdd").alias("date"), F.explode(F.from_json("bands", "map<string,double>")).alias("band", "mean"))
    return each


def clean(spark: SparkSession, root: str, derived: list[str]) -> list[str]:
    """Deletes the named derived tables below ``root`` and returns those that were there.

    Names with a path in them are refused, so nothing outside ``root`` and no input is touched.
    """
    gone = []
    for name in derived:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not the name of a derived table: {name!r}")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.delete(p, True):
            gone.append(name)
    return gone


def array_metadata(spark: SparkSession, root: str) -> DataFrame:
    """path, shape, chunks, dtype, fill_value, attributes of the arrays of a chunked array store.

    Spark's file sources pass over names with a leading dot, so the small JSON files, down to two
    folders below ``root``, are read through the file system; chunks are never listed.
    """
    jvm = spark._jvm
    found: dict[str, dict[str, str]] = {}
    for depth in ("", "*/", "*/*/"):
        for name in (".zarray", ".zattrs"):
            p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{depth}{name}")
            fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
            for status in fs.globStatus(p) or []:
                stream = fs.open(status.getPath())
                try:
                    text = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
                found.setdefault(status.getPath().getParent().toString(), {})[name] = text
    rows = [(k, v[".zarray"], v.get(".zattrs")) for k, v in sorted(found.items()) if ".zarray" in v]
    t = spark.createDataFrame(rows, "path string, _c string, attributes string")
    m = F.from_json("_c", "shape array<bigint>, chunks array<bigint>, dtype string, fill_value string")
    return t.select("path", m.alias("_m"), "attributes").select("path", "_m.*", "attributes")
