"""Durations to speeds, by thresholds for each episode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A last speed without a bound takes everything up to this.
OPEN_END = 65535
#: Threshold tables up to so many rows are broadcast.
BROADCAST_ROWS = 100_000


def with_speed(rows: DataFrame, thresholds: DataFrame, name: str = "name", duration: str = "duration_ms") -> DataFrame:
    """``rows`` with ``speed``: that of the smallest bound which the duration does not exceed; null for unknown episodes and beyond all bounds.

    thresholds(episode, speed, max_ms) is folded to one row an episode, so a row meets one row.
    """
    bounds = thresholds.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("max_ms", F.col("speed").alias("of")))).alias("bounds"))
    small = thresholds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(bounds) if small else bounds, rows[name] == bounds["episode"], "left")
    hit = F.try_element_at(F.filter("bounds", lambda b: F.col(duration) <= b["max_ms"]), F.lit(1))
    return joined.withColumn("speed", hit["of"]).drop("episode", "bounds")
