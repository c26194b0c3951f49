"""The event tables as page views: one event is one page view with one episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmine.functions import items as I
from tiltmine.functions.discretize import with_speed
from tiltmine.operators import windows
from tiltmine.sources import thresholds
from tiltmine.storage import signature, store

THRESHOLDS = """\
click,fast,15,acceptable,70,slow
view,fast,20,acceptable,80,slow
purchase,fast,15,acceptable,60,slow
signup,fast,10,acceptable,50,slow
error,fast,25,acceptable,100,slow
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def speeds(spark: SparkSession) -> DataFrame:
    return thresholds.parse(spark.createDataFrame([(line,) for line in THRESHOLDS.splitlines()], "value string"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, region, nation, segment); nations and regions are dimensions of 25 and 5 rows."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return who.select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with duration, speed, place and status."""
    e = table(spark, sf_dir, "events").withColumn("duration_ms", F.floor("value").cast("int"))
    e = with_speed(e, speeds(spark), "event_type").withColumn("status", F.floor(F.get_json_object("props", "$.k").try_cast("int") / 25).cast("int"))
    e = e.withColumn("status", F.when(F.get_json_object("props", "$.k").try_cast("int") != 0, F.col("status")))
    e = e.withColumn("time_s", windows.epoch_seconds(F.col("ts"))).withColumn("quarter", windows.quarter(F.col("time_s")))
    return e.join(places(spark, sf_dir), "user_id", "left")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, time_s, quarter, event_type, speed, items)."""
    own = F.array(I.item("episode", F.col("event_type")), I.item("duration", F.col("speed")), I.item("segment", F.col("segment")), I.item("status", F.col("status")))
    return views(spark, sf_dir).select("event_id", "time_s", "quarter", "event_type", "speed", "region", "segment", I.transaction(own, I.prefixes("location", F.col("region"), F.col("nation"))).alias("items"))


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_batches(transactions(spark, sf_dir))


_STORED: dict[tuple, DataFrame] = {}


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batched`` as a table in the order of batches, written once and read by every question after that.

    It is written anew when one of its source tables has changed.  Filters on batch_id skip its row groups.
    """
    sources = tuple(signature(spark, f"{sf_dir}/{t}.parquet*") for t in ("events", "customer", "nation", "region"))
    key = (spark.sparkContext.applicationId, sf_dir, sources)
    if key not in _STORED:
        made = batched(spark, sf_dir)
        _STORED[key] = store(made.repartitionByRange("batch_id").sortWithinPartitions("batch_id"), "transactions")
    return _STORED[key]
