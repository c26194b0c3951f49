"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmine.llm.shared import discard, materialize

#: Steps after which a run is given up; each step about halves the depth of every tree.
MOST_STEPS = 60


def _min_table(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``: root is the smallest node it reaches.

    Minima are aggregated before the shuffle, and the join back is an ordinary
    one that Spark can split where a hub has many edges.  Nothing is collected
    but one row of counts a step.  Loops, repeated edges and nulls are ignored;
    no edges give no rows.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(pairs, "cc")
    for _ in range(MOST_STEPS):
        # large-star: every larger neighbour of u hangs on the smallest one around u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _min_table(both)
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours hang on the smallest of them
        small = large.join(_min_table(large), F.col("u") == F.col("k"))
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(hung, "cc")
        discard(now)
        now = after
        # settled when every edge ends at a root: no end is a beginning too, and no beginning has two ends
        ends = now.select(F.col("v").alias("end")).distinct()
        if now.join(ends, F.col("u") == F.col("end"), "left_semi").isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
