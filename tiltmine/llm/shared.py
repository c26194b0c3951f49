"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark runs in one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tiltmine-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, which ends its lineage; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tiltmine/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tiltmine_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_tiltmine_path", None)
    if path:
        p, fs = _path(df.sparkSession, path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of a caller cannot clash with ours."""
    return df.select(*[df[c] for c in columns])
