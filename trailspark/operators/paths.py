"""Shortest paths and signed levels over links, walked both ways from many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Transactions that a path tells at most.
REFS = 10


def case_links(edges: DataFrame) -> DataFrame:
    """(case_id, payer, payee, tx_hash) of a trace's edges: walked backward, the address found is the payer."""
    back = F.col("direction") == "backward"
    return edges.select("case_id", F.when(back, F.col("dst")).otherwise(F.col("src")).alias("payer"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("payee"), "tx_hash")


def linked_search(links: DataFrame, roots: DataFrame, walls: DataFrame | None = None, max_levels: int | None = None, refs: int = REFS) -> DataFrame:
    """(case_id, address, hops, level, parent, tx_hash, path): breadth-first search of every case over links both ways.

    ``links`` has payer, payee, tx_hash and, where cases do not share them, case_id; ``roots`` has case_id, root.
    ``hops`` is the least number of links, ``level`` the steps with the payment less those against it along the path,
    ``path`` its first ``refs`` transactions. Of several parents the smallest address wins, then the step with the
    payment, then the smallest transaction. ``walls`` (case_id, address) may end a path and never carry one; a root
    goes on. Without ``max_levels`` the search ends when a level finds nothing.

    Links with a null end and from an address to itself lead nowhere; repeated links count once; roots that repeat
    count once and null ones not at all. A root without links is found itself, with an empty path. Empty tables give
    no rows. Each level is written to the shared folder; the driver learns whether it is empty.
    """
    own = ["case_id"] if "case_id" in links.columns else []
    ends = links.where("payer is not null and payee is not null and payer <> payee").select(*own, "payer", "payee", "tx_hash")
    step = lambda a, b, sign: ends.select(*own, F.col(a).alias("parent"), F.col(b).alias("address"), F.lit(sign).alias("sign"), "tx_hash")
    both = step("payer", "payee", 1).unionByName(step("payee", "payer", -1)).groupBy(*own, "parent", "address", "sign").agg(F.min("tx_hash").alias("tx_hash"))
    both = materialize(both, "links")
    root = roots.where("case_id is not null and root is not null").select("case_id", F.col("root").alias("address")).distinct()
    null = F.lit(None).cast("string")
    level = materialize(root.select("*", F.lit(0).alias("hops"), F.lit(0).alias("level"), null.alias("parent"), null.alias("tx_hash"), F.array().cast("array<string>").alias("path")), "search")
    found, hop = level, 0
    while max_levels is None or hop < max_levels:
        going = level if walls is None or not hop else level.join(walls.select("case_id", "address").distinct(), ["case_id", "address"], "left_anti")
        seen = going.select("case_id", F.col("address").alias("parent"), F.col("level").alias("_level"), F.col("path").alias("_path")).join(both, [*own, "parent"])
        seen = seen.join(found.select("case_id", "address"), ["case_id", "address"], "left_anti")
        first = seen.groupBy("case_id", "address").agg(F.min(F.struct("parent", (-F.col("sign")).alias("turn"), "tx_hash", "_level", "_path")).alias("x"))
        hop += 1
        path = F.slice(F.concat("x._path", F.array("x.tx_hash")), 1, refs)
        level = materialize(first.select("case_id", "address", F.lit(hop).alias("hops"), (F.col("x._level") - F.col("x.turn")).alias("level"), "x.parent", "x.tx_hash", path.alias("path")), "search")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def drawing_levels(addresses: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, address, level, place): signed levels for drawing; what the search did not reach is at 0, a level is stacked by address."""
    told = addresses.select("case_id", "address").distinct().join(found.select("case_id", "address", "level"), ["case_id", "address"], "left").na.fill(0, ["level"])
    return told.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "level").orderBy("address")))
