"""Tilted time windows as arithmetic.

With n batches seen, the bucket that holds batch j (0-based) is a function of n and j
alone: 4 quarters, 24 hours, 31 days, 12 months, 1 year.  A full level rolls up when
the next value comes; the oldest year is dropped.  So no window is ever stored or
shifted: range queries filter batches by their bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("quarter", "hour", "day", "month", "year")
SIZES = (4, 24, 31, 12, 1)
OFFSETS = (0, 4, 28, 59, 71)
BUCKETS = 72
#: Quarters that one bucket of each level spans.
WEIGHTS = (1, 4, 96, 2976, 35712)
#: Named ranges: first and last bucket. They read completed buckets only.
RANGES = {"quarter": (0, 0), "hour": (4, 4), "day": (28, 28), "week": (28, 34), "month": (59, 59), "year": (71, 71), "all": (0, 71)}


def bucket_of(n: int, j: int) -> int | None:
    """Bucket of batch j of n; None where it has been dropped."""
    if not 0 <= j < n:
        return None
    last, index = n, j
    for level, size in enumerate(SIZES):
        rolled = (last - 1) // size if last > 0 else 0  # groups that have left this level
        if level == len(SIZES) - 1:
            return OFFSETS[level] if index == last - 1 else None
        if index >= rolled * size:
            return OFFSETS[level] + last - 1 - index
        last, index = rolled, index // size
    return None


def bucket(n: Column | int, j: Column) -> Column:
    """``bucket_of`` as an expression; null where the batch has been dropped or does not exist."""
    n = F.lit(n) if isinstance(n, int) else n
    div = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    lasts, indexes = [n.cast("long")], [j.cast("long")]
    for size in SIZES[:-1]:
        lasts.append(F.greatest(div(lasts[-1] - 1, size), F.lit(0)))
        indexes.append(div(indexes[-1], size))
    out = F.when(indexes[4] == lasts[4] - 1, F.lit(OFFSETS[4]))
    for level in (3, 2, 1, 0):
        stays = indexes[level] >= lasts[level + 1] * SIZES[level]
        out = F.when(stays, OFFSETS[level] + lasts[level] - 1 - indexes[level]).otherwise(out)
    return F.when((j >= 0) & (j < n), out).cast("int")


def distance(bucket_number: int, inclusive: bool = False) -> int:
    """Quarters between now and the young end of a bucket (its old end, if inclusive)."""
    if not 0 <= bucket_number < BUCKETS:
        raise ValueError(f"no bucket {bucket_number}")
    total, left = 0, bucket_number + inclusive
    for size, weight in zip(SIZES, WEIGHTS):
        total += min(size, left) * weight
        left -= min(size, left)
    return total


def first_batch(n: int, last_bucket: int) -> int:
    """The oldest batch in buckets up to ``last_bucket``."""
    batches = [j for j in _edges(n) if (b := bucket_of(n, j)) is not None and b <= last_bucket]
    return min(batches, default=n)


def batch_range(n: int, first: int, last: int) -> tuple[int, int]:
    """The batches (from, to), inclusive, that buckets first..last hold; empty if from > to.

    Known on the driver, so that a filter on batch numbers prunes partitions of stored state.
    """
    oldest = first_batch(n, last)
    newest = first_batch(n, first - 1) - 1 if first > 0 else n - 1
    return oldest, newest


def _edges(n: int) -> set[int]:
    """Batches at which a bucket can begin."""
    out = {0}
    last, span = n, 1
    for size in SIZES:
        rolled = (last - 1) // size if last > 0 else 0
        out |= {i * span for i in range(max(0, rolled * size), max(0, last))} if size > 1 else {max(0, last - 1) * span}
        last, span = rolled, span * size
    return {j for j in out if 0 <= j < n}


@dataclass(frozen=True)
class Clock:
    """Wall-clock span of a bucket range."""

    start: int
    end: int


def clock(first_time: int, last_time: int, first: int, last: int, batch_seconds: int = 900) -> Clock:
    """Span of buckets first..last, for data between two epoch seconds; never before the first."""
    latest = last_time - last_time % batch_seconds + batch_seconds
    return Clock(max(first_time, latest - distance(last, True) * batch_seconds), latest - distance(first) * batch_seconds)


def range_sum(state: DataFrame, n: int, first: int, last: int, value: str = "support", key: str = "pattern") -> DataFrame:
    """Sum of ``value`` by key over the batches in buckets first..last."""
    low, high = batch_range(n, first, last)
    return state.where(F.col("batch_id").between(low, high)).groupBy(key).agg(F.sum(value).alias(value))


def windows(state: DataFrame, n: int, value: str = "support", key: str = "pattern") -> DataFrame:
    """(key, bucket, value): the window view; unused buckets are absent."""
    return state.withColumn("bucket", bucket(n, F.col("batch_id"))).where("bucket is not null").groupBy(key, "bucket").agg(F.sum(value).alias(value))


def dump(window_rows: DataFrame, first_n: int = BUCKETS, value: str = "support", key: str = "pattern") -> DataFrame:
    """(key, buckets): the first buckets of each window as an array of at most BUCKETS, null where unused."""
    found = F.map_from_entries(F.collect_list(F.struct("bucket", value)))
    return window_rows.where(F.col("bucket") < first_n).groupBy(key).agg(F.transform(F.sequence(F.lit(0), F.lit(first_n - 1)), lambda b: F.try_element_at(found, b)).alias("buckets"))


def drop_tail(state: DataFrame, n: int, level: int) -> DataFrame:
    """State without the batches of a level and all older ones; level 0 leaves nothing."""
    return state.where(bucket(n, F.col("batch_id")) < OFFSETS[level])
