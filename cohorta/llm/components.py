"""Connected components of a graph given as pairs, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.common import discard, staged


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hangs a node's larger (large) or smaller (small) neighbours on its smallest one.

    ``pairs`` holds (u, v) with u != v, each pair in one direction.
    """
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of a pair (columns a, b); component: its smallest node.

    Pairs may repeat, come in either order and join a node with itself. No pairs, no rows.
    Each round costs two aggregations and joins; their number grows with the logarithm of
    the size of the largest component.
    """
    now = staged(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct(), "pairs")
    size = now.count()
    while size:
        new = staged(_star(_star(now, True), False), "stars")
        same = new.count() == size and new.join(now, ["u", "v"], "left_anti").isEmpty()  # both are sets
        discard(now)
        now = new
        if same:
            break
        size = now.count()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
