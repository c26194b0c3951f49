"""Batches of time, and questions about ranges of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.functions import tilted
from tiltmine.operators.mining import minimum_count


def quarter(time_s: Column, seconds: int = 900) -> Column:
    """The number of the tumbling window that an epoch second falls in."""
    return F.floor(time_s / F.lit(seconds)).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without zone, as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def with_batches(rows: DataFrame, quarter_column: str = "quarter", calendar: bool = False) -> DataFrame:
    """``rows`` with ``batch_id``: numbers of non-empty quarters in order, or, by the calendar, of all since the first.

    The numbering is over distinct quarters: a row each 15 minutes of data.
    """
    quarters = rows.select(quarter_column).where(F.col(quarter_column).isNotNull()).distinct()
    if calendar:
        first = quarters.agg(F.min(quarter_column).alias("q0"))
        return rows.crossJoin(F.broadcast(first)).withColumn("batch_id", (F.col(quarter_column) - F.col("q0")).cast("int")).drop("q0")
    numbered = quarters.withColumn("batch_id", F.expr(f"cast(row_number() over (order by {quarter_column}) - 1 as int)"))
    return rows.join(F.broadcast(numbered), quarter_column)


def open_quarter(rows: DataFrame, order: str, quarter_column: str = "quarter", chunk: int = 1 << 20) -> DataFrame:
    """``rows`` with ``open_quarter``: the latest quarter up to the row in reading order, where late rows are put.

    A running maximum in two steps: over chunks of the order, then within each; no task takes all rows.
    """
    cut = F.floor(F.col(order) / F.lit(chunk)).alias("chunk")
    tops = rows.groupBy(cut).agg(F.max(quarter_column).alias("top"))
    before = tops.select("chunk", F.expr("max(top) over (order by chunk rows between unbounded preceding and 1 preceding)").alias("before"))
    own = rows.withColumn("chunk", F.floor(F.col(order) / F.lit(chunk))).join(before, "chunk")
    running = F.expr(f"max({quarter_column}) over (partition by chunk order by {order} rows between unbounded preceding and current row)")
    return own.withColumn("open_quarter", F.greatest(running, F.col("before"))).drop("chunk", "before")


def batch_sizes(transactions: DataFrame, event: str) -> DataFrame:
    """(batch_id, events, transactions, ratio): ratio is transactions per event."""
    sizes = transactions.groupBy("batch_id").agg(F.count_distinct(event).alias("events"), F.count(F.lit(1)).alias("transactions"))
    return sizes.withColumn("ratio", F.col("transactions") / F.col("events"))


def events_in(sizes: DataFrame, n: int, first: int, last: int) -> int:
    """Events of the batches in buckets first..last."""
    low, high = tilted.batch_range(n, first, last)
    return int(sizes.where(F.col("batch_id").between(low, high)).agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0])


def events_in_union(sizes: DataFrame, n: int, ranges: list[tuple[int, int]]) -> int:
    """Events of the batches in any of the ranges, each once."""
    test = F.lit(False)
    for first, last in ranges:
        low, high = tilted.batch_range(n, first, last)
        test = test | F.col("batch_id").between(low, high)
    return int(sizes.where(test).agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0])


def range_itemsets(state: DataFrame, n: int, first: int, last: int, sigma: float, events: int) -> DataFrame:
    """(items, support) of the patterns above the minimum support of a range (strictly)."""
    total = tilted.range_sum(state, n, first, last, key="items")
    return total.where(F.col("support") > minimum_count(sigma, events))


def cumulative_tail(window_rows: DataFrame, key: str = "pattern", value: str = "support") -> DataFrame:
    """``window_rows`` with the sums of each bucket and all older ones."""
    return window_rows.withColumn("cumulative", F.expr(f"sum({value}) over (partition by {key} order by bucket desc rows between unbounded preceding and current row)"))


def least_to_keep(older: DataFrame, sizes: DataFrame, newest: int, sigma: float, epsilon: float, key: str = "pattern") -> DataFrame:
    """(key, least): the support in the newest batch, of ``newest`` events, from which a window keeps anything.

    older(key, bucket, support) and sizes(bucket, size) as in ``droppable_tails``, without the newest batch: a window
    goes as a whole if all its older buckets are below both bounds and the newest one is, too.
    """
    rows = cumulative_tail(older.join(F.broadcast(sizes), "bucket"), key).withColumn("z", F.expr(f"sum(size) over (partition by {key} order by bucket desc rows between unbounded preceding and current row)"))
    below = F.expr(f"support < ceil(round({sigma}D * size, 9)) and cumulative < ceil(round({epsilon}D * z, 9))")
    sums = rows.groupBy(key).agg(F.min(below).alias("below"), F.sum("support").alias("s"), F.sum("size").alias("z"))
    least = F.expr(f"least(ceil(round({sigma}D * {newest}, 9)), ceil(round({epsilon}D * (z + {newest}), 9)) - s)")
    return sums.select(key, F.when(F.col("below"), least).otherwise(0).cast("long").alias("least"))


def droppable_tails(window_rows: DataFrame, sizes: DataFrame, sigma: float, epsilon: float, key: str = "pattern") -> DataFrame:
    """(key, drop_from): the bucket from which a window's tail can be dropped; null where none can.

    window_rows(key, bucket, support), sizes(bucket, size).  From the oldest bucket on, those below sigma of their
    batches form the tail; of it, as long as the sums from the oldest on stay below epsilon, the youngest is m; whole
    levels from the first that begins at m or later are droppable.  Buckets without a size are passed over.
    """
    over = f"over (partition by {key} order by bucket desc rows between unbounded preceding and current row)"
    rows = window_rows.join(F.broadcast(sizes), "bucket")  # at most 72 rows
    ceil = lambda share, x: f"ceil(round({share}D * {x}, 9))"
    rows = rows.withColumn("tail", F.expr(f"min(support < {ceil(sigma, 'size')}) {over}"))
    rows = rows.withColumn("s", F.expr(f"sum(support) {over}")).withColumn("z", F.expr(f"sum(size) {over}"))
    rows = rows.withColumn("below", F.expr(f"min(tail and s < {ceil(epsilon, 'z')}) {over}"))
    m = rows.groupBy(key).agg(F.min(F.when(F.col("below"), F.col("bucket"))).alias("m"))
    level = F.lit(None).cast("int")
    for offset in reversed(tilted.OFFSETS):
        level = F.when(F.col("m") <= offset, F.lit(offset)).otherwise(level)
    return m.select(key, level.alias("drop_from"))
