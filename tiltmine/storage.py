"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark runs in one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tiltmine-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path that nobody uses yet, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which ends its lineage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tiltmine_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Deletes what ``store`` wrote for ``df``; nothing may read it any more."""
    if path := getattr(df, "_tiltmine_path", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of what stands at a path: another one when it is written anew."""
    p, fs = _hadoop(spark, path)
    found = fs.globStatus(p)
    return tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (found or []))
