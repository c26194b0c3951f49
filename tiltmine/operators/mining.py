"""Frequent itemsets.

Two ways with the same result: expansion of each transaction into its subsets, one
aggregation with map-side combine, for bounded sizes and for counts by batch; and
MLlib's FP-growth, partitioned by item, for sets of any size.  Before expansion,
transactions are reduced to items that are frequent by themselves, and items are
numbered: a subset is one whole number, its items the digits, so that what is
shuffled and grouped are longs and only sets that are frequent get their names back.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.operators.constraints import Constraints

#: Frequent items up to which they are numbered in the plan; beyond, FP-growth is used, which finds them itself.
LITERAL_ITEMS = 256
#: Subsets are expanded up to this size of the longest transaction; beyond, FP-growth is used.
EXPANDED_ITEMS = 14
#: Itemsets asked for, up to which they are broadcast.
BROADCAST_SETS = 100_000


def minimum_count(share: float, events: int, strict: bool = False) -> int:
    """The smallest count that passes: ``>= ceil(share * events)``, or ``>`` that. Products are rounded before, as 0.05 * 20 is 1."""
    return math.ceil(round(share * events, 9)) + strict


def item_support(transactions: DataFrame, items: str = "items", by: tuple[str, ...] = ()) -> DataFrame:
    """(item, support), one count a transaction however often it has the item."""
    return transactions.select(*by, F.explode(F.array_distinct(items)).alias("item")).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("support"))


def ranked_items(transactions: DataFrame, minimum: int, items: str = "items") -> DataFrame:
    """(item, support, position): frequent items by falling support, then by name."""
    frequent = item_support(transactions, items).where(F.col("support") >= minimum)
    return frequent.withColumn("position", F.expr("cast(row_number() over (order by support desc, item) as int)"))  # a row an item, not a transaction


def _names(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def _known(transactions: DataFrame, minimum: int, items: str) -> list[str] | None:
    """The frequent items, sorted; None if there are more than LITERAL_ITEMS."""
    frequent = item_support(transactions, items).where((F.col("support") >= minimum) & F.col("item").isNotNull())
    found = [r.item for r in frequent.select("item").limit(LITERAL_ITEMS + 1).collect()]
    return sorted(found) if len(found) <= LITERAL_ITEMS else None


def only_frequent(transactions: DataFrame, known: list[str], items: str = "items") -> DataFrame:
    """Transactions reduced to known items."""
    return transactions.withColumn(items, F.array_sort(F.array_intersect(F.array_distinct(items), _names(known))))


def subsets(items: Column, max_len: int | None = None, min_len: int = 1) -> Column:
    """All subsets of a sorted array, each sorted, of min_len up to max_len items."""
    fits = (lambda s: F.size(s) < max_len) if max_len else (lambda s: F.lit(True))
    grown = F.aggregate(
        items, F.array(F.array().cast("array<string>")), lambda all_, x: F.concat(all_, F.transform(F.filter(all_, fits), lambda s: F.concat(s, F.array(x))))
    )
    return F.filter(grown, lambda s: F.size(s) >= min_len)


def counted_subsets(transactions: DataFrame, max_len: int | None = None, items: str = "items", by: tuple[str, ...] = (), known: list[str] | None = None, longest: int | None = None, minimum: int = 1) -> DataFrame:
    """(items, support) of every subset in at least ``minimum`` transactions.

    With the ``known`` items, to which others are dropped, subsets are numbers where a long holds them: of at most
    max_len, or longest, items.
    """
    size = min(x for x in (max_len, longest, 64) if x)
    base = len(known) + 1 if known is not None else 0
    if known and base**size < 1 << 63:
        own = F.array_sort(F.transform(F.array_intersect(F.array_distinct(items), _names(known)), lambda x: F.array_position(_names(known), x)))
        grow = lambda all_, x: F.concat(all_, F.array(x), F.transform(F.filter(all_, lambda s: s < base ** (size - 1)), lambda s: s * base + x))
        numbers = transactions.select(*by, F.explode(F.aggregate(own, F.array().cast("array<bigint>"), grow)).alias("number"))
        counted = numbers.groupBy(*by, "number").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= minimum)
        powers = F.array(*[F.lit(base**i).cast("long") for i in reversed(range(size))])
        digits = F.transform(powers, lambda p: F.get(_names(known), (F.floor(F.call_function("div", F.col("number"), p)) % base - 1).cast("int")))
        return counted.select(*by, F.array_compact(digits).alias("items"), "support")
    own = F.array_distinct(items) if known is None else F.array_intersect(F.array_distinct(items), _names(known))
    rows = transactions.select(*by, F.explode(subsets(F.array_sort(own), max_len)).alias("items"))
    return rows.groupBy(*by, "items").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= minimum)


def frequent_itemsets(transactions: DataFrame, minimum: int, constraints: Constraints | None = None, max_len: int | None = None, items: str = "items") -> DataFrame:
    """(items, support) of the sets in at least ``minimum`` transactions (1 at least) that pass the constraints; items sorted."""
    minimum, transactions = max(1, minimum), transactions.select(items)
    known, longest = _known(transactions, minimum, items), max_len
    if known is not None and (max_len is None or max_len > 3):
        longest = only_frequent(transactions, known, items).agg(F.max(F.size(items))).first()[0] or 0
    if known is not None and longest <= max(EXPANDED_ITEMS, 3 if max_len and max_len <= 3 else 0):
        sets = counted_subsets(transactions, max_len, items, (), known, max(longest, 1), minimum)
    else:
        sets = _grown(transactions if known is None else only_frequent(transactions, known, items), minimum, max_len, items)
    return constraints.filter(sets, item_support(transactions, items).select("item")) if constraints else sets


def _grown(transactions: DataFrame, minimum: int, max_len: int | None, items: str) -> DataFrame:
    """The same by FP-growth."""
    baskets = transactions.select(F.array_compact(F.array_distinct(items)).alias("items")).where(F.size("items") > 0)
    n = baskets.count()
    if n < minimum:
        return baskets.select("items", F.lit(0).cast("long").alias("support")).where("false")
    # half a count below, so that rounding up gives the minimum itself
    model = FPGrowth(itemsCol="items", minSupport=(minimum - 0.5) / n).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))
    return sets.where(F.size("items") <= max_len) if max_len else sets


def support_of(transactions: DataFrame, wanted: DataFrame, items: str = "items") -> DataFrame:
    """(items, support): exact supports of the wanted(items) sets, 0 included.

    A transaction meets a set by the set's rarest item, so that frequent items deal out nothing; sets are broadcast up to BROADCAST_SETS.
    """
    sets = wanted.select(F.array_sort(F.array_distinct("items")).alias("items")).distinct()
    asked = sets.where(F.size("items") > 0).select("items", F.explode("items").alias("item")).join(item_support(transactions, items), "item", "left")
    asked = asked.groupBy("items").agg(F.min_by("item", F.struct(F.coalesce("support", F.lit(0)), "item")).alias("rarest"))
    small = sets.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    tx = transactions.select(F.array_distinct(items).alias("own")).withColumn("rarest", F.explode("own"))
    hits = tx.join(F.broadcast(asked) if small else asked, "rarest").where(F.size(F.array_except("items", "own")) == 0).groupBy("items").agg(F.count(F.lit(1)).alias("support"))
    return sets.join(hits, "items", "left").select("items", F.coalesce("support", F.lit(0)).alias("support"))


def by_batch(transactions: DataFrame, max_len: int | None = None, items: str = "items", by: str = "batch_id") -> DataFrame:
    """(batch_id, items, support): exact counts, the rows that state is made of."""
    known = _known(transactions, 1, items)
    longest = None if max_len else transactions.agg(F.max(F.size(items))).first()[0] or 1
    return counted_subsets(transactions, max_len, items, (by,), known, longest)


def tree_size(itemsets: DataFrame, ranked: DataFrame) -> DataFrame:
    """(patterns, nodes, leaves) of the prefix tree that holds the itemsets, in the order of the ranked(item, position) items.

    Nodes are the distinct prefixes of the patterns, those that are no pattern themselves included.
    """
    placed = itemsets.select("items", F.explode("items").alias("item")).join(ranked.select("item", "position"), "item")
    path = placed.groupBy("items").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda x: x["position"]).alias("path"))
    # each node with whether it goes on: a row a prefix of a pattern
    nodes = path.select(F.size("path").alias("n"), "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("i"))
    nodes = nodes.select(F.slice("path", F.lit(1), F.col("i")).alias("node"), (F.col("i") < F.col("n")).alias("inner"), (F.col("i") == F.col("n")).alias("pattern"))
    nodes = nodes.groupBy("node").agg(F.bool_or("inner").alias("inner"), F.bool_or("pattern").alias("pattern"))
    return nodes.agg(F.count_if("pattern").alias("patterns"), F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("inner")).alias("leaves"))
