"""Co-spend clusters: spending transactions, refusals, components, label proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .components import connected_components


def spending(halves: DataFrame) -> DataFrame:
    """By transaction: distinct input addresses, outputs, and how often the commonest output amount occurs."""
    ins = halves.where("kind = 'utxo_input' and from_addr is not null").groupBy("chain", "tx_hash").agg(F.count_distinct("from_addr").alias("inputs"), F.min("from_addr").alias("first_input"))
    outs = halves.where("kind = 'utxo_output'").groupBy("chain", "tx_hash", "amount").agg(F.count("*").alias("n")).groupBy("chain", "tx_hash").agg(F.sum("n").alias("outputs"), F.max("n").alias("equal_outputs"))
    return ins.join(outs, ["chain", "tx_hash"], "left").na.fill(0, ["outputs", "equal_outputs"])


def judged(spends: DataFrame, halves: DataFrame, mixers: DataFrame, least_inputs: int = 3, least_equal: int = 2) -> DataFrame:
    """``spends`` with ``verdict``: single, mixer, coinjoin or joined; in this order."""
    m = mixers.select("chain", "address").distinct()
    ends = halves.select("chain", "tx_hash", F.coalesce("from_addr", "to_addr").alias("address"))
    touched = ends.join(m, ["chain", "address"], "left_semi").select("chain", "tx_hash").distinct().withColumn("_m", F.lit(True))
    out = spends.join(touched, ["chain", "tx_hash"], "left")
    shape = (F.col("inputs") >= least_inputs) & (F.col("equal_outputs") >= least_equal)
    return out.withColumn("verdict", F.when(F.col("inputs") < 2, "single").when(F.col("_m"), "mixer").when(shape, "coinjoin").otherwise("joined")).drop("_m")


def cospend_clusters(halves: DataFrame, mixers: DataFrame) -> DataFrame:
    """(chain, address, cluster): input addresses that accepted transactions join; the smallest names a cluster."""
    good = judged(spending(halves), halves, mixers).where("verdict = 'joined'").select("chain", "tx_hash", "first_input")
    star = halves.where("kind = 'utxo_input' and from_addr is not null").join(good, ["chain", "tx_hash"]).select("chain", F.col("first_input").alias("a"), F.col("from_addr").alias("b")).where("a <> b").distinct()
    # addresses of two chains never meet: the chain is part of the node
    tag = lambda c: F.concat_ws("\x1f", "chain", c)
    found = connected_components(star.select(tag("a").alias("src"), tag("b").alias("dst")))
    part = lambda c, i: F.element_at(F.split(c, "\x1f"), i)
    return found.select(part("node", 1).alias("chain"), part("node", 2).alias("address"), part("component", 2).alias("cluster"))


def proposals(clusters: DataFrame, labels: DataFrame, share: float = 0.9) -> DataFrame:
    """Unlabelled members of clusters with one entity get its name at ``share`` of the seed's confidence.

    The seed is the claim of highest confidence, then of the first address. Clusters with two
    entities and more are refused whole; rows with ``refused`` true tell of them.
    """
    active = labels.where("status = 'active'").select("chain", "address", "entity", "confidence").distinct()
    known = clusters.join(active, ["chain", "address"])
    seed = F.min(F.struct(-F.col("confidence"), "address", "entity")).alias("s")
    per = known.groupBy("chain", "cluster").agg(F.count_distinct("entity").alias("entities"), seed)
    per = materialize(per.select("chain", "cluster", "entities", F.col("s.entity").alias("entity"), (-F.col("s.col1")).alias("seed_confidence"), F.col("s.address").alias("seed")), "seeds")
    bare = clusters.join(active.select("chain", "address"), ["chain", "address"], "left_anti")
    out = bare.join(per, ["chain", "cluster"])
    return out.withColumn("refused", F.col("entities") > 1).withColumn("confidence", F.when(~F.col("refused"), F.bround(F.col("seed_confidence") * share, 3)))


def coverage(clusters: DataFrame, proposed: DataFrame) -> DataFrame:
    """One row a chain: clusters, addresses, largest cluster, newly named addresses, refused clusters."""
    sizes = clusters.groupBy("chain", "cluster").agg(F.count("*").alias("n"))
    a = sizes.groupBy("chain").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_addresses"), F.max("n").alias("largest"))
    b = proposed.groupBy("chain").agg(F.count_if(~F.col("refused")).alias("newly_named"), F.count_distinct(F.when(F.col("refused"), F.col("cluster"))).alias("refused_clusters"))
    return a.join(b, "chain", "left").na.fill(0, ["newly_named", "refused_clusters"])


def size_histogram(clusters: DataFrame) -> DataFrame:
    """Clusters by size."""
    return clusters.groupBy("chain", "cluster").agg(F.count("*").alias("size")).groupBy("chain", "size").agg(F.count("*").alias("n_clusters"))


