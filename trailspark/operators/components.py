"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of an edge reaches.

    Large-star and small-star rounds: neighbours are hung below the smallest neighbour, so a
    path shrinks by a constant factor a round. Each round is written to the shared folder; the
    loop ends when a round leaves count and checksum of the edges as they were, and raises if
    ``most_rounds`` do not do (a path needs about its logarithm). Self-loops and repeated edges
    are harmless; null ends are dropped; a table without edges has no nodes.
    """
    start = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    # written with its self-loops, so that what made the edges runs once
    kept = materialize(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = kept.where("a <> b")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == before:
            break
        before, last = mark, now
        now = materialize(_small_star(_large_star(last)), "edges")
        release(last)
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    below = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().join(below.select("node"), "node", "left_anti")
    alone = kept.where("a = b").select(F.col("a").alias("node"))
    found = below.unionByName(roots.withColumn("component", F.col("node")))
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours below the smallest of its neighbours and itself."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.where("b > a").join(low, "a")
    return up.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself below the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    hung = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
