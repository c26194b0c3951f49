"""An analysis: supports by batch, rules of a range of time, comparison of two ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmine.functions import tilted
from tiltmine.functions.items import hierarchy
from tiltmine.operators import mining, rules, windows
from tiltmine.operators.constraints import Constraints, Kind, defaults, with_consequent
from tiltmine.options import Options
from tiltmine.storage import release, store
from tiltmine.streaming.state import PrunedState

#: Estimates of what an item and a pattern take, in bytes.
ITEM_BYTES, PATTERN_BYTES, ROOT_BYTES = 4 + 80, 292 + 12, 12


class Analyst:
    """Works on transactions(batch_id, <event>, time_s, items), or on stored exact state.

    Supports are kept without constraints and filtered at the end, so antecedents are always known.
    """

    def __init__(self, options: Options = Options()):
        self.options = options
        self.itemsets, self.consequent = defaults()
        self.state: DataFrame | None = None
        self.sizes: DataFrame | None = None
        self.transactions: DataFrame | None = None
        self.n = 0
        self._tables: list[DataFrame] = []

    def add_itemset_constraint(self, kind: Kind, *names: str) -> Analyst:
        self.itemsets.add(kind, *names)
        return self

    def add_consequent_constraint(self, kind: Kind, *names: str) -> Analyst:
        self.consequent.add(kind, *names)
        return self

    def analyze(self, transactions: DataFrame, event: str = "event_id") -> Analyst:
        """Counts the batches of the transactions."""
        self.transactions = transactions
        self._sized(windows.batch_sizes(transactions, event))
        self.state = mining.by_batch(transactions, self.options.max_len) if self.options.max_len else None
        return self

    def load(self, state: DataFrame, sizes: DataFrame) -> Analyst:
        """Goes on with supports(items, batch_id, support) and sizes(batch_id, events, transactions)."""
        self.state, self.transactions = state, None
        self._sized(sizes)
        return self

    def load_pruned(self, state: PrunedState, version: int) -> Analyst:
        """Goes on with pruned state after a batch: supports are at most epsilon of the events below the true ones."""
        return self.load(state.patterns(version).withColumnRenamed("pattern", "items"), state.sizes(version))

    def _sized(self, sizes: DataFrame) -> None:
        """Keeps the sizes, a row a batch, as a table of their own."""
        self._keep(sizes := store(sizes, "sizes"))
        self.sizes = sizes
        last = sizes.agg(F.max("batch_id")).first()[0]
        self.n = 0 if last is None else last + 1

    def _keep(self, table: DataFrame) -> DataFrame:
        self._tables.append(table)
        return table

    def close(self) -> None:
        """Deletes the tables that answers were made from; answers that are not stored cannot be read any more."""
        for table in self._tables:
            release(table)
        self._tables.clear()

    @staticmethod
    def _buckets(span: str | tuple[int, int]) -> tuple[int, int]:
        return tilted.RANGES[span] if isinstance(span, str) else span

    def events(self, span: str | tuple[int, int]) -> int:
        return windows.events_in(self.sizes, self.n, *self._buckets(span))

    def _own(self, span: str | tuple[int, int]) -> DataFrame:
        low, high = tilted.batch_range(self.n, *self._buckets(span))
        return (self.transactions if self.transactions is not None else self.state).where(F.col("batch_id").between(low, high))

    def itemsets_of(self, span: str | tuple[int, int]) -> DataFrame:
        """All frequent itemsets of a range, unconstrained.

        From transactions at hand, only those of the range and only their frequent items are
        expanded; from stored state, the range's batches are summed.
        """
        if self.transactions is not None:
            return mining.frequent_itemsets(self._own(span), mining.minimum_count(self.options.sigma, self.events(span), strict=True), max_len=self.options.max_len)
        return windows.range_itemsets(self.state, self.n, *self._buckets(span), self.options.sigma, self.events(span))

    def vocabulary(self, span: str | tuple[int, int]) -> DataFrame:
        """(item): the items known in a range, frequent or not."""
        return self._own(span).select(F.explode("items").alias("item")).distinct()

    def mine(self, span: str | tuple[int, int] = "all") -> DataFrame:
        """Rules of a range; its frequent sets are stored, as they are read as sets and as antecedents."""
        supports = self._keep(store(self.itemsets_of(span), "itemsets"))
        wanted = with_consequent(self.itemsets, self.consequent)
        known = self.vocabulary(span)
        return rules.mine(wanted.filter(supports, known), supports, self.options.confidence, self.consequent, vocabulary=known)

    def compare(self, older: str | tuple[int, int], newer: str | tuple[int, int]) -> DataFrame:
        return rules.compare(self.mine(older), self.mine(newer), self.events(older), self.events(newer))

    def events_of_both(self, older: str | tuple[int, int], newer: str | tuple[int, int]) -> int:
        return windows.events_in_union(self.sizes, self.n, [self._buckets(older), self._buckets(newer)])

    def hierarchy(self) -> DataFrame:
        return hierarchy(self.transactions.select(F.explode("items").alias("item")).distinct())

    def statistics(self, event: str = "event_id") -> DataFrame:
        return statistics(self.transactions, self.options, event)


def statistics(transactions: DataFrame, options: Options = Options(), event: str = "event_id", max_len: int | None = None) -> DataFrame:
    """One row: first and last time, page views, transactions, unique and frequent items, and what the items take.

    With ``max_len``, also the patterns of epsilon and more, the nodes of their tree, and what these take.
    """
    whole = transactions.agg(F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.count_distinct(event).alias("page_views"), F.count(F.lit(1)).alias("transactions"))
    support = mining.item_support(transactions)
    joined = support.crossJoin(F.broadcast(whole))  # one row
    counts = joined.agg(
        F.count(F.lit(1)).alias("unique_items"), F.coalesce(F.sum((F.col("support") >= F.ceil(F.round(F.lit(options.sigma) * F.col("page_views"), 9))).cast("long")), F.lit(0)).alias("frequent_items")
    )
    out = whole.crossJoin(F.broadcast(counts)).withColumn("item_bytes", F.col("unique_items") * ITEM_BYTES)
    if not max_len:
        return out
    minimum = mining.minimum_count(options.epsilon, transactions.select(event).distinct().count())
    tree = mining.tree_size(mining.frequent_itemsets(transactions, minimum, max_len=max_len), mining.ranked_items(transactions, minimum))
    return out.crossJoin(F.broadcast(tree)).withColumn("pattern_bytes", F.col("nodes") * PATTERN_BYTES + ROOT_BYTES)


def why_slow(transactions: DataFrame, antecedents, holds, events: int, options: Options) -> DataFrame:
    """The default question in one aggregation: which circumstances go with slow episodes."""
    return rules.one_consequent(transactions, antecedents, holds, mining.minimum_count(options.sigma, events), options.confidence)


__all__ = ["Analyst", "Constraints", "Kind", "statistics", "why_slow"]
