"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per vertex (combined before the shuffle) and a join,
never a list of neighbours. The minima are written before they are joined, so that the join's sides are
shuffled anew (or the smaller one is broadcast, by its known size) and a vertex with any number of edges is split like
other skewed keys. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u now hangs on the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small(edges: DataFrame) -> DataFrame:
    """u (a > b) and all its smaller neighbours now hang on the least of them."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """v, root of every vertex that has an edge; edges has columns a and b, and root is the least vertex."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        after = written(_small(_large(now).distinct()).distinct(), "edges")
        # done when every vertex hangs on one vertex, and that hangs on none
        tops = after.select(F.col("b").alias("a")).distinct()
        if not after.join(tops, "a", "left_semi").take(1):
            if not after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
                break
        now = after
    return after.select(F.col("a").alias("v"), F.col("b").alias("root")).union(after.select("b", "b").distinct())
