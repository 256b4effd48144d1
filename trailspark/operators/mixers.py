"""Mixer activity and the ladder of exits, for all anchors of all mixers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import SMALL_ROWS, materialize, sized_broadcast

POOL = ["chain", "mixer", "asset"]
EVENT = [*POOL, "party", "tx_hash", "side", "amount", "ts", "gas_price"]
#: Rung and its confidence before it is shared among candidates.
RUNGS = {1: ("address-match@1", 0.8), 2: ("linked-address@1", 0.7), 3: ("unique-gas-price@1", 0.65), 4: ("pool-fingerprint@1", 0.6), 5: ("anonymity-set@1", 0.5)}


def activity(movements: DataFrame, mixers: DataFrame) -> DataFrame:
    """Deposits and withdrawals of every mixer: one row a transaction, party, pool and side, the largest."""
    m = materialize(mixers.select("chain", F.col("address").alias("mixer")).distinct(), "mixers")
    m = sized_broadcast(m, m.count(), SMALL_ROWS)
    cols = ["chain", "tx_hash", "asset", "amount", "ts", "gas_price"]
    into = movements.join(m, (movements["chain"] == m["chain"]) & (movements["to_addr"] == m["mixer"])).select(*[movements[c] for c in cols], "mixer", F.col("from_addr").alias("party"), F.lit("deposit").alias("side"))
    out = movements.join(m, (movements["chain"] == m["chain"]) & (movements["from_addr"] == m["mixer"])).select(*[movements[c] for c in cols], "mixer", F.col("to_addr").alias("party"), F.lit("withdrawal").alias("side"))
    both = into.unionByName(out).where("party is not null and party <> mixer")
    both = both.join(m.withColumnRenamed("mixer", "party"), ["chain", "party"], "left_anti")
    rest = ["ts", "gas_price"]
    best = F.max(F.struct("amount", *rest)).alias("b")
    return both.groupBy(*POOL, "party", "tx_hash", "side").agg(best).select(*POOL, "party", "tx_hash", "side", F.col("b.amount").alias("amount"), *[F.col(f"b.{c}").alias(c) for c in rest])


def anchors(events: DataFrame, direction: str = "forward") -> DataFrame:
    """For each mixer and party the largest event on the side a direction arrives at, and how many others there are."""
    side = "deposit" if direction == "forward" else "withdrawal"
    own = events.where(F.col("side") == side)
    top = F.max(F.struct("amount", "tx_hash", "asset", "ts", "gas_price")).alias("t")
    got = own.groupBy("chain", "mixer", "party").agg(top, (F.count_distinct("tx_hash") - 1).alias("unanchored"))
    return got.select("chain", "mixer", "party", "unanchored", F.col("t.asset").alias("asset"), F.col("t.amount").alias("amount"), F.col("t.tx_hash").alias("tx_hash"), F.col("t.ts").alias("ts"), F.col("t.gas_price").alias("gas_price"))


def _far(events: DataFrame, direction: str) -> DataFrame:
    side = "withdrawal" if direction == "forward" else "deposit"
    names = {"party": "far", "tx_hash": "far_tx", "amount": "far_amount", "ts": "far_ts", "gas_price": "far_gas"}
    return events.where(F.col("side") == side).select(*POOL, *[F.col(k).alias(v) for k, v in names.items()])


def _later(direction: str):
    return F.col("far_ts") > F.col("ts") if direction == "forward" else F.col("far_ts") < F.col("ts")


def crowd(anchor: DataFrame, events: DataFrame, direction: str = "forward", days: int = 7) -> DataFrame:
    """Anchors with every far event of the pool strictly on the far side of time, within ``days``.

    A range join through buckets of ``days``: an anchor goes to its own bucket and the next one
    in the direction, a far event to its own.
    """
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (days * 86_400))
    step = 1 if direction == "forward" else -1
    a = anchor.withColumn("slot", F.explode(F.array(slot("ts"), slot("ts") + step)))
    f = _far(events, direction).withColumn("slot", slot("far_ts"))
    gap = F.abs(F.unix_micros(F.col("far_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    return a.join(f, [*POOL, "slot"]).where(_later(direction) & (gap <= days * 86_400 * 1_000_000)).drop("slot").withColumn("gap_us", gap)


def exits(movements: DataFrame, events: DataFrame, anchor: DataFrame, direction: str = "forward", days: int = 7, keep: int = 20) -> DataFrame:
    """The first rung of the ladder with matches for each anchor: candidates with shared confidence.

    An anchor is known by mixer, party and transaction. Rungs 1 to 3 are equi-joins for all anchors;
    4 compares sets of pools; 5, the crowd in time, runs for anchors that none of them answers and
    is ranked by value, nearness and transaction.
    """
    far = _far(events, direction)
    own = ["chain", "mixer", "party"]
    key = [*own, "tx_hash"]
    base = [*key, "asset", "unanchored", "far", "far_tx", "far_ts", "far_amount"]
    # each rung finds which far addresses it allows, then meets the pool's events by address: no
    # rung joins all anchors of a pool with all its events
    meet = lambda allowed: anchor.join(allowed, own).join(far, [*POOL, "far"]).where(_later(direction))
    one = meet(anchor.select(*own, F.col("party").alias("far")).distinct()).select(*base, F.lit(1).alias("rung"))
    ends = movements.where("from_addr is not null and to_addr is not null and from_addr <> to_addr")
    ties = ends.select("chain", F.least("from_addr", "to_addr").alias("lo"), F.greatest("from_addr", "to_addr").alias("hi")).distinct()
    tied = ties.select("chain", F.col("lo").alias("party"), F.col("hi").alias("far")).unionByName(ties.select("chain", F.col("hi").alias("party"), F.col("lo").alias("far")))
    two = meet(anchor.select(*own).distinct().join(tied, ["chain", "party"])).select(*base, F.lit(2).alias("rung"))
    own_side, far_side = ("deposit", "withdrawal") if direction == "forward" else ("withdrawal", "deposit")
    priced = events.where("gas_price > 0").groupBy("chain", "mixer", "gas_price").agg(F.count_if(F.col("side") == far_side).alias("n_far"), F.count_if(F.col("side") == own_side).alias("n_own"))
    single = priced.where("n_far = 1 and n_own = 1").select("chain", "mixer", "gas_price")
    three = anchor.join(single, ["chain", "mixer", "gas_price"]).join(far, (far["far_gas"] == F.col("gas_price")) & (far["chain"] == anchor["chain"]) & (far["mixer"] == anchor["mixer"]) & (far["asset"] == anchor["asset"]))
    three = three.where(_later(direction)).select(*[anchor[c] for c in (*key, "asset", "unanchored")], "far", "far_tx", "far_ts", "far_amount", F.lit(3).alias("rung"))
    prints = lambda side: events.where(F.col("side") == side).groupBy("chain", "mixer", "party", "asset").agg(F.count("*").alias("n")).groupBy("chain", "mixer", "party").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "asset", F.col("n").cast("string")))), ",").alias("print"), F.count("*").alias("pools")).where("pools >= 2")
    theirs = prints(far_side).withColumn("same", F.count("*").over(Window.partitionBy("chain", "mixer", "print"))).where("same = 1").select("chain", "mixer", "print", F.col("party").alias("far"))
    four = prints(own_side).select(*own, "print").join(theirs, ["chain", "mixer", "print"]).select(*own, "far")
    four = meet(four.distinct()).select(*base, F.lit(4).alias("rung"))
    early = one.unionByName(two).unionByName(three).unionByName(four)
    left = anchor.join(early.select(*key).distinct(), key, "left_anti")
    near = crowd(left, events, direction, days)
    w = Window.partitionBy(*key)
    near = near.withColumn("crowd", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("far_amount"), "gap_us", "far_tx", "far")))
    five = near.where(F.col("place") <= keep).select(*base, F.lit(5).alias("rung"), "crowd")
    both = early.withColumn("crowd", F.lit(None).cast("long")).unionByName(five)
    best = both.withColumn("first", F.min("rung").over(w)).where("rung = first").drop("first")
    # one row a candidate address; confidence is shared by distinct addresses
    cand = best.groupBy(*key, "asset", "unanchored", "rung", "far").agg(F.min("far_tx").alias("far_tx"), F.max("crowd").alias("crowd"), F.max("far_amount").alias("far_amount"))
    n = F.count("*").over(w)
    shared = F.when(F.col("rung") == 5, F.least(F.lit(0.5), 1 / F.col("crowd"))).otherwise(F.element_at(F.create_map(*[F.lit(x) for k, (_, c) in RUNGS.items() for x in (k, c)]), F.col("rung")) / n)
    return cand.withColumn("confidence", F.greatest(F.bround(shared, 3), F.lit(0.001))).withColumn("capped", F.coalesce(F.col("crowd") > keep, F.lit(False)))


def enqueue(candidates: DataFrame, nodes: DataFrame, roots: DataFrame, keep: int = 20) -> DataFrame:
    """Candidates with what becomes of them: queued, or dropped as root, known to the trace or past the cap."""
    known = nodes.select("chain", F.col("address").alias("far")).distinct().withColumn("_k", F.lit(True))
    own = roots.select("chain", F.col("root").alias("far")).distinct().withColumn("_r", F.lit(True))
    w = Window.partitionBy("chain", "mixer", "party").orderBy(F.desc("confidence"), "far")
    out = candidates.withColumn("_p", F.row_number().over(w)).join(own, ["chain", "far"], "left").join(known, ["chain", "far"], "left")
    fate = F.when(F.col("_r"), "root").when(F.col("_k"), "known").when(F.col("_p") > keep, "over_cap").otherwise("queued")
    basis = F.concat_ws(" ", F.element_at(F.create_map(*[F.lit(x) for k, (n, _) in RUNGS.items() for x in (k, n)]), F.col("rung")), F.col("mixer"))
    return out.withColumn("fate", fate).withColumn("speculative_basis", basis).drop("_k", "_r", "_p")
