"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.sources.cube_store import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node of its component.

    Each round hangs every larger neighbour of a node under the node's
    smallest neighbour, then the smaller ones, until the table is a set of
    stars; the number of rounds grows with the logarithm of the longest
    path.  Every round is a table in the shared checkpoint folder, so a lost
    executor costs one round.  Rows with a null end or equal ends are dropped.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = materialize(edges, "links"), None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        near = both.join(least, "a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b"), (F.col("b") > F.col("a")).alias("up"))
        large = near.where("up and a <> b").select("a", "b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("m").alias("b"))
                 .where("a <> b").distinct())
        now = materialize(small, "links")
        state = now.agg(F.count("*").alias("n"),
                        F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if last == state:
            break
        last = state
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
