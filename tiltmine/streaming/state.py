"""Pattern supports over time, batch by batch.

EXACT keeps the support of every itemset of each batch; windows, thresholds and
constraints are questions asked of it.  PRUNED keeps an approximation in bounded
space: in a batch, a set is explored only if the set without its first item (in the
order of the item list) was known and still has a window; unknown sets are inserted
and not explored further; tails that cannot matter are dropped.

Pruned state is a table in versions, one a batch number: a batch that is run again writes
the same version again.  Rows are (pattern, batch_id, support), zeros written out in
PRUNED state; a pattern is known if it has rows.  Buckets follow from batch numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiltmine.functions import tilted
from tiltmine.operators import mining, windows
from tiltmine.operators.constraints import Constraints
from tiltmine.storage import release, remove, store

STATE = "pattern array<string>, batch_id int, support long"
SIZES = "batch_id int, events long, transactions long"
ITEMS = "item string, position int"


class ExactState:
    """Exact supports by quarter, in parts: a part that is written again replaces itself, so parts can be retried.

    A part is whatever was folded at a time, a batch or an epoch of a stream; supports of one quarter in several
    parts are summed when they are read, so late rows go to their own quarter whenever they come.

    A transaction of n items has 2**n sets, so sets are kept up to max_len items; None keeps all.
    """

    def __init__(self, spark: SparkSession, path: str, max_len: int | None = 3):
        self.spark, self.path, self.max_len = spark, path.rstrip("/"), max_len

    def fold(self, transactions: DataFrame, part: int, event: str = "line_id") -> None:
        """transactions(quarter, items, <event>): all transactions of an event are in one part."""
        sets = mining.by_batch(transactions, self.max_len, by="quarter")
        sets.select(F.col("quarter").cast("long").alias("quarter"), "items", "support").write.mode("overwrite").parquet(f"{self.path}/patterns/part={part}")
        sizes = transactions.groupBy(F.col("quarter").cast("long").alias("quarter")).agg(F.count_distinct(event).alias("events"), F.count(F.lit(1)).alias("transactions"))
        sizes.write.mode("overwrite").parquet(f"{self.path}/sizes/part={part}")

    def process(self, transactions: DataFrame, batch_id: int, event: str = "line_id") -> None:
        """transactions(items, <event>) of one batch."""
        self.fold(transactions.withColumn("quarter", F.lit(batch_id).cast("long")), batch_id, event)

    def _sized(self) -> DataFrame:
        parts = self.spark.read.schema("quarter long, events long, transactions long, part int").parquet(f"{self.path}/sizes")
        return parts.groupBy("quarter").agg(F.sum("events").alias("events"), F.sum("transactions").alias("transactions"))

    def sizes(self) -> DataFrame:
        """(quarter, batch_id, events, transactions): the quarters that have events, numbered in order."""
        return self._sized().withColumn("batch_id", F.expr("cast(row_number() over (order by quarter) - 1 as int)"))  # a row a quarter

    def patterns(self) -> DataFrame:
        """(items, quarter, batch_id, support)."""
        parts = self.spark.read.schema("quarter long, items array<string>, support long, part int").parquet(f"{self.path}/patterns")
        summed = parts.groupBy("quarter", "items").agg(F.sum("support").alias("support"))
        return summed.join(F.broadcast(self.sizes().select("quarter", "batch_id")), "quarter").select("items", "quarter", "batch_id", "support")


class PrunedState:
    """The approximation; ``path`` holds a version after each batch."""

    def __init__(self, spark: SparkSession, path: str, sigma: float, epsilon: float, constraints: Constraints | None = None):
        self.spark, self.path, self.sigma, self.epsilon, self.constraints = spark, path.rstrip("/"), sigma, epsilon, constraints

    def _read(self, name: str, schema: str, version: int) -> DataFrame:
        if version < 0:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{version}")

    def _work(self, df: DataFrame, name: str, schema: str, version: int) -> DataFrame:
        path = f"{self.path}/work/v{version}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, df: DataFrame, name: str, schema: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{version}")
        return self._read(name, schema, version)

    def patterns(self, version: int) -> DataFrame:
        return self._read("patterns", STATE, version)

    def windows(self, version: int) -> DataFrame:
        return tilted.windows(self.patterns(version), version + 1)

    def sizes(self, version: int) -> DataFrame:
        return self._read("sizes", SIZES, version)

    def process(self, transactions: DataFrame, batch_id: int, event: str = "line_id") -> DataFrame:
        """Folds transactions(items, <event>) into the state; returns the patterns after it.

        Work tables are deleted when the version stands; of the versions, this one and the one before it are kept.
        """
        out = self._fold(transactions, batch_id, event)
        remove(self.spark, f"{self.path}/work/v{batch_id}")
        for name in ("patterns", "sizes", "items"):
            remove(self.spark, f"{self.path}/{name}/v{batch_id - 2}")
        return out

    def _fold(self, transactions: DataFrame, batch_id: int, event: str) -> DataFrame:
        n, v = batch_id + 1, batch_id
        old = self.patterns(v - 1)
        size = transactions.agg(F.count_distinct(event).alias("events"), F.count(F.lit(1)).alias("transactions"))
        sizes = self._write(self._read("sizes", SIZES, v - 1).unionByName(size.select(F.lit(batch_id).alias("batch_id"), "events", "transactions")), "sizes", SIZES, v)
        events = sizes.where(F.col("batch_id") == batch_id).first().events
        minimum = max(1, int(round(self.epsilon * events, 9)))

        # items keep their place once they have one; new ones follow by falling support
        listed = self._read("items", ITEMS, v - 1)
        frequent = self._work(mining.item_support(transactions).where(F.col("support") >= minimum), "frequent", "item string, support long", v)
        start = listed.count()
        fresh = frequent.join(listed, "item", "left_anti").select("item", F.expr(f"cast({start - 1} + row_number() over (order by support desc, item) as int)").alias("position"))
        listed = self._write(listed.unionByName(fresh), "items", ITEMS, v)

        place = listed.join(frequent.select("item"), "item")
        tx = transactions.select(F.monotonically_increasing_id().alias("tx"), F.array_distinct("items").alias("items"))
        ordered = tx.select("tx", F.explode("items").alias("item")).join(place, "item").groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("l"))
        ordered = self._work(ordered.select("tx", F.transform("l", lambda x: x["item"]).alias("items")), "transactions", "tx long, items array<string>", v)

        if v > 0:
            known = self._work(self._known(old, sizes, n, events), "known", "pattern array<string>, least long", v)
        rows = ordered.select("tx", "items", F.posexplode("items").alias("at", "item")).select("tx", "items", "at", F.array("item").alias("pattern"))
        updated = self._read("patterns", STATE, -1)
        level = 0
        while True:
            level += 1
            counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= minimum)
            counts = self._work(counts, f"level{level}", "pattern array<string>, support long", v)
            if counts.isEmpty():
                break
            if v == 0:
                grown = self.constraints.filter(counts, transactions.select(F.explode("items").alias("item")), "pattern") if self.constraints else counts
                opened = counts
            else:
                grown, opened = counts, counts.join(known, "pattern").where("support >= least")
            updated = updated.unionByName(grown.select("pattern", F.lit(batch_id).alias("batch_id"), "support"))
            # grow by each item that stands before the first of the set
            rows = rows.join(opened.select("pattern"), "pattern", "left_semi").where("at > 0")
            rows = rows.select("tx", "items", "pattern", F.posexplode(F.expr("slice(items, 1, at)")).alias("at", "item")).select("tx", "items", "at", F.concat(F.array("item"), F.col("pattern")).alias("pattern"))
            rows = self._work(rows, f"rows{level}", "tx long, items array<string>, at int, pattern array<string>", v)

        if v == 0:
            return self._write(updated, "patterns", STATE, v)
        # a pattern that is new begins with its hour, and keeps its window in its first batch
        new = updated.join(known, "pattern", "left_anti")
        since = F.explode(F.sequence(F.lit(4 * (batch_id // 4)), F.lit(batch_id)))
        new = new.select("pattern", since.alias("b"), F.col("support").alias("s")).select("pattern", F.col("b").alias("batch_id"), F.expr(f"if(b = {batch_id}, s, 0L)").alias("support"))
        now = known.join(updated, "pattern", "left").select("pattern", F.lit(batch_id).alias("batch_id"), F.coalesce("support", F.lit(0).cast("long")).alias("support"))
        return self._write(self._without_tails(old.unionByName(now), sizes, n).unionByName(new), "patterns", STATE, v)

    def _known(self, old: DataFrame, sizes: DataFrame, n: int, events: int) -> DataFrame:
        """(pattern, least): patterns of the state, and the support in batch n - 1 from which they keep a window."""
        by_bucket = sizes.where(F.col("batch_id") < n - 1).withColumn("bucket", tilted.bucket(n, F.col("batch_id"))).where("bucket is not null").groupBy("bucket").agg(F.sum("events").alias("size"))
        least = windows.least_to_keep(tilted.windows(old, n), by_bucket, events, self.sigma, self.epsilon)
        alone = F.expr(f"cast(least(ceil(round({self.sigma}D * {events}, 9)), ceil(round({self.epsilon}D * {events}, 9))) as long)")  # no older bucket is left
        return old.select("pattern").distinct().join(least, "pattern", "left").withColumn("least", F.coalesce("least", alone))

    def _without_tails(self, rows: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
        number = tilted.bucket(n, F.col("batch_id"))
        window = tilted.windows(rows, n)
        by_bucket = sizes.withColumn("bucket", number).where("bucket is not null").groupBy("bucket").agg(F.sum("events").alias("size"))
        drop = windows.droppable_tails(window, by_bucket, self.sigma, self.epsilon)
        kept = rows.withColumn("bucket", number).join(drop, "pattern", "left").where("bucket is not null and (drop_from is null or bucket < drop_from)")
        return kept.select("pattern", "batch_id", "support")


def replay(transactions: DataFrame, state, event: str = "line_id") -> int:
    """Folds transactions(batch_id, items, <event>) into a state in order; returns the number of batches."""
    last = transactions.agg(F.max("batch_id")).first()[0]
    for b in range(0 if last is None else last + 1):
        state.process(transactions.where(F.col("batch_id") == b), b, event)
    return 0 if last is None else last + 1


def follow(lines: DataFrame, prepare: Callable[[DataFrame], DataFrame], state: ExactState, checkpoint: str):
    """A stream of log lines into exact state: an epoch's lines become transactions, and these a part of the state.

    ``prepare(lines)`` gives transactions(line_id, quarter, items); lines get a ``line_id`` of their epoch before.
    An epoch that is run again, after a loss, writes its part again.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        staged = store(batch.withColumn("line_id", F.monotonically_increasing_id()), "staged")  # a line keeps its number
        made = store(prepare(staged).select("line_id", "quarter", "items"), "prepared")
        state.fold(made, epoch)
        release(made)
        release(staged)

    return run_available(lines, fold, checkpoint)


def stream_quarters(stream: DataFrame, ts: str, keys: list[str], seconds: int = 900) -> DataFrame:
    """Counts by closed quarter and keys of a stream; the open quarter waits for the watermark."""
    late = stream.withWatermark(ts, f"{seconds} seconds")
    return late.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("support")).select((F.unix_timestamp("w.start") / seconds).cast("long").alias("quarter"), *keys, "support")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there, then ends; ``handle(batch, epoch)`` must be idempotent by epoch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def throughput(progress: dict, episodes_per_view: float = 1.0, patterns_per_view: float = 0.0) -> dict[str, float]:
    """Rates of a streaming progress report: page views, episodes and patterns a second."""
    rate = float(progress.get("processedRowsPerSecond") or 0)
    return {"page_views_per_s": rate, "episodes_per_s": rate * episodes_per_view, "patterns_per_s": rate * patterns_per_view}


def rates(sizes: DataFrame, patterns: DataFrame, seconds: int = 900) -> DataFrame:
    """(batch_id, page_views_per_s, episodes_per_s, patterns_per_s) of each batch, over the time that it spans."""
    found = patterns.groupBy("batch_id").agg(F.count(F.lit(1)).alias("found"))
    rate = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(seconds))
    return sizes.join(found, "batch_id", "left").select("batch_id", rate("events").alias("page_views_per_s"), rate("transactions").alias("episodes_per_s"), rate("found").alias("patterns_per_s"))
