"""Joins of addresses to labels, sanctions, operator metadata and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPPRESSING = "infrastructure"


def canonical(address: Column) -> Column:
    """Hex addresses in lower case, prefix included; case-significant encodings as they are; bech32 in lower case."""
    return F.when(address.rlike("^0[xX][0-9a-fA-F]{40}$"), F.lower(address)).when(F.lower(address).rlike("^(bc|tb)1[02-9ac-hj-np-z]+$"), F.lower(address)).otherwise(address)


def attributed(addresses: DataFrame, labels: DataFrame) -> DataFrame:
    """Active claims on addresses, best first: confidence descending, source, entity; ``place`` 1 is the top claim."""
    active = labels.where("status = 'active'")
    w = Window.partitionBy("chain", "address").orderBy(F.desc("confidence"), "source", "entity", "category", "role", "source_date")
    # claims are ranked before the join, so an address with many movements costs nothing more
    return addresses.join(active.withColumn("place", F.row_number().over(w)), ["chain", "address"])


def precedence(labels: DataFrame) -> DataFrame:
    """One row a labelled address: what a node does there. A mixer beats a named service."""
    has = lambda c: F.bool_or(F.col("category") == c)
    out = labels.where("status = 'active'").groupBy("chain", "address").agg(
        has("mixer").alias("mixer"), has("vasp").alias("vasp"), has("sanctioned").alias("sanctioned"), has(SUPPRESSING).alias("infrastructure")
    )
    return out.withColumn("action", F.when(F.col("mixer"), "mixer").when(F.col("vasp"), "endpoint").otherwise("continue"))


def screened(addresses: DataFrame, labels: DataFrame, category: str = "sanctioned") -> DataFrame:
    """Distinct addresses that an active claim of a category names."""
    hit = labels.where((F.col("status") == "active") & (F.col("category") == category)).select("chain", "address")
    return addresses.select("chain", "address").distinct().join(hit, ["chain", "address"], "left_semi")


def unnamed(endpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct endpoint addresses without an active claim."""
    return endpoints.select("chain", "address").distinct().join(labels.where("status = 'active'").select("chain", "address"), ["chain", "address"], "left_anti")


def entity_stem(entity: Column) -> Column:
    """Entity without parentheses and trailing number, lower case, single spaces; digits alone give the empty text."""
    e = F.regexp_replace(entity, r"\([^)]*\)", "")
    e = F.regexp_replace(F.trim(e), r"[\s\-_]+\d+$", "")
    e = F.trim(F.regexp_replace(F.lower(e), r"\s+", " "))
    return F.when(e.rlike(r"^[\d\s\-_]*$"), "").otherwise(e)


def with_metadata(named: DataFrame, metadata: DataFrame) -> DataFrame:
    """Claims with their operator's metadata by entity stem; serviceable when jurisdiction and legal entity are known."""
    meta = metadata.select(entity_stem(F.col("entity")).alias("stem"), "jurisdiction", "legal_entity")
    out = named.withColumn("stem", F.nullif(entity_stem(F.col("entity")), F.lit(""))).join(meta, "stem", "left")
    return out.withColumn("serviceable", F.col("jurisdiction").isNotNull() & F.col("legal_entity").isNotNull())


def pending_leads(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with the number of pending claims beside them and their entities; these never attribute."""
    leads = labels.where("status = 'pending'").groupBy("chain", "address").agg(F.count("*").alias("n_leads"), F.array_join(F.array_sort(F.collect_set("entity")), "|").alias("leads"))
    return nodes.join(leads, ["chain", "address"], "left").withColumn("n_leads", F.coalesce("n_leads", F.lit(0)))


def case_probe(sides: DataFrame, labels: DataFrame, top: int | None = 10) -> DataFrame:
    """Addresses that touch both mixers and named services, by distinct such counterparties; a top-k report."""
    kind = labels.where("status = 'active'").select("chain", F.col("address").alias("other"), "category").where("category in ('mixer', 'vasp')").distinct()
    pairs = sides.select("chain", "address", "other", "tx_hash").where("other is not null and other <> address")
    # distinct pairs first: a hub's many movements with one address count once
    touch = pairs.select("chain", "address", "other").distinct().join(kind, ["chain", "other"])
    both = touch.groupBy("chain", "address").agg(F.count_if(F.col("category") == "mixer").alias("mixers"), F.count_if(F.col("category") == "vasp").alias("vasps")).where("mixers > 0 and vasps > 0")
    txs = pairs.groupBy("chain", "address").agg(F.count_distinct("tx_hash").alias("n_txs"))
    out = both.join(txs, ["chain", "address"])
    return out if top is None else out.orderBy(F.desc("mixers"), F.desc("vasps"), "address").limit(top)


def valued(movements: DataFrame, prices: DataFrame) -> DataFrame:
    """Movements with the latest price of their asset at or before their day; without one, value 0.

    Prices of an asset and day are few; each holds from its day to the day before the next, or,
    for the last, to the asset's last movement. Movements meet the filled days by an equi-join on
    asset and day, so no task sorts an asset's movements, and a day's hot asset is split as
    adaptive execution sees fit.
    """
    day = F.to_date("ts")
    p = prices.groupBy("asset", F.to_date("day").alias("d")).agg(F.max("price").alias("price"))
    ends = movements.groupBy("asset").agg(F.max(day).alias("end"))
    after = F.lead("d").over(Window.partitionBy("asset").orderBy("d"))
    spans = p.withColumn("until", after).join(ends, "asset").withColumn("until", F.coalesce(F.date_sub("until", 1), "end")).where("d <= until")
    filled = spans.select("asset", F.explode(F.sequence("d", F.least("until", F.greatest("end", "d")))).alias("_day"), "price")
    out = movements.withColumn("_day", day).join(filled, ["asset", "_day"], "left").drop("_day")
    price = F.coalesce("price", F.lit(0.0))
    return out.withColumn("price", price).withColumn("usd", F.col("amount").cast("double") * F.col("price"))
