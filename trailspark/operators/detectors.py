"""Behavioural detectors over all addresses: aggregates, range joins and a grouped matcher.

Detectors read evidence-grade movements, at most 500 of the newest a side and address (see
``facts.comparable_window``), which also bounds every group that leaves the JVM.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = "0x" + "0" * 40


def refs(column: str = "tx_hash", n: int = 8) -> Column:
    """The first ``n`` of the sorted distinct transactions, comma-joined."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, n), ",")


def fan_in(window: DataFrame, least: int = 8) -> DataFrame:
    """Addresses with many distinct senders; strength n / 32, confidence .5 + .25 strength, at most .9."""
    got = window.where("side = 'in' and other is not null").groupBy("chain", "address").agg(F.count_distinct("other").alias("senders"), refs().alias("refs")).where(F.col("senders") >= least)
    s = F.least(F.col("senders") / 32, F.lit(1.0))
    return got.withColumn("strength", F.bround(s, 3)).withColumn("confidence", F.bround(F.least(0.5 + 0.25 * s, F.lit(0.9)), 3))


def distribution(window: DataFrame, least: int = 8, equal: int = 4) -> DataFrame:
    """How an address pays out: fan-out, batches of equal amounts, or an equal split.

    The largest group of equal amounts of one asset decides between the three.
    """
    out = window.where("side = 'out' and other is not null")
    per = out.groupBy("chain", "address").agg(F.count_distinct("other").alias("recipients"), refs().alias("refs"))
    same = out.where("amount > 0").groupBy("chain", "address", "asset", "amount_str").agg(F.count("*").alias("n"))
    top = same.groupBy("chain", "address").agg(F.max("n").alias("equal"))
    got = per.join(top, ["chain", "address"], "left").withColumn("equal", F.coalesce("equal", F.lit(0)))
    fanned, grouped = F.col("recipients") >= least, F.col("equal") >= equal
    name = F.when(fanned & grouped & (F.col("equal") >= 0.8 * F.col("recipients")), "batch-distribution@1").when(fanned, "fan-out@1").when(grouped, "equal-split@1")
    return got.withColumn("heuristic", name).where("heuristic is not null")


def service_endpoint(window: DataFrame, infrastructure: DataFrame | None = None, senders: int = 25, recipients: int = 25, total: int = 60) -> DataFrame:
    """Addresses that both receive from and pay many; not the zero address, not infrastructure."""
    got = window.where(F.col("other").isNotNull() & (F.col("address") != ZERO)).groupBy("chain", "address").agg(
        F.count_distinct(F.when(F.col("side") == "in", F.col("other"))).alias("senders"), F.count_distinct(F.when(F.col("side") == "out", F.col("other"))).alias("recipients")
    )
    got = got.where((F.col("senders") >= senders) & (F.col("recipients") >= recipients) & (F.col("senders") + F.col("recipients") >= total))
    if infrastructure is not None:
        got = got.join(infrastructure.select("chain", "address"), ["chain", "address"], "left_anti")
    both = (F.col("senders") + F.col("recipients")).cast("double")
    return got.withColumn("confidence", F.bround(F.least(0.55 + 0.20 * F.least(both / 400, F.lit(1.0)), F.lit(0.75)), 3))


def onward(window: DataFrame, seconds: int) -> DataFrame:
    """Receipts and sends of one address and asset with the send 0 to ``seconds`` later: range join by buckets.

    Receipts go to their own bucket of ``seconds`` and sends to their own and the one before, so
    the join is an equi-join; a pair meets once.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = window.where("amount > 0").select("chain", "address", "asset", "side", "tx_hash", "idx", "amount", "ts", micros.alias("us"))
    width = max(1, seconds) * 1_000_000
    slot = F.floor(F.col("us") / width)
    key = ["chain", "address", "asset", "slot"]
    names = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("tx_hash", "idx", "amount", "ts", "us")]
    got = rows.where("side = 'in'").withColumn("slot", slot).select(*key, *names("in"))
    sent = rows.where("side = 'out'").withColumn("slot", F.explode(F.array(slot, slot - 1))).select(*key, *names("out"))
    gap = F.col("out_us") - F.col("in_us")
    return got.join(sent, key).where((gap >= 0) & (gap <= seconds * 1_000_000)).drop("slot")


def peel_chain(window: DataFrame, seconds: int = 6 * 3600) -> DataFrame:
    """Receipts split soon after into one large and some small sends; the first of each address.

    At least two same-asset sends in the window, the largest .7 to 1 of the receipt and the
    smallest more than 0 and at most .3 of it.
    """
    pairs = onward(window, seconds)
    per = pairs.groupBy("chain", "address", "asset", "in_tx_hash", "in_idx", "in_amount", "in_ts", "in_us").agg(F.count("*").alias("sends"), F.max("out_amount").alias("most"), F.min("out_amount").alias("least"))
    ratio = lambda c: F.col(c).cast("double") / F.col("in_amount").cast("double")
    ok = per.where((F.col("sends") >= 2) & ratio("most").between(0.7, 1.0) & (F.col("least") > 0) & (ratio("least") <= 0.3))
    w = Window.partitionBy("chain", "address").orderBy("in_us", "in_tx_hash", "in_idx", "asset")
    first = ok.withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.withColumn("ratio", F.bround(ratio("most"), 3)).withColumn("confidence", F.bround(F.least(0.55 + 0.25 * F.least(ratio("most"), F.lit(1.0)), F.lit(0.9)), 3)).drop("r", "in_us")


_PAIRS = "chain string, address string, asset string, in_tx string, out_tx string, in_amount decimal(38,0), out_amount decimal(38,0), ratio double, delay_us long"


def match_group(g: pd.DataFrame, low: float, high: float, width: int, same_tx: bool) -> list[tuple[int, int]]:
    """Greedy pairs (receipt, send) of one address and asset, in time order; a send is used once.

    Amounts are whole numbers and compared as such: a send one unit over a receipt is no part of
    it. The lower bound is a share in millionths.
    """
    parts = round(low * 1_000_000)
    ins = g[g["side"] == "in"].sort_values(["us", "tx_hash", "idx"], kind="stable")
    outs = g[g["side"] == "out"].sort_values(["us", "tx_hash", "idx"], kind="stable")
    oi, ou, oa, ot = outs.index.tolist(), outs["us"].tolist(), outs["value"].tolist(), outs["tx_hash"].tolist()
    used, pairs, first = [False] * len(oi), [], 0
    for i, us, value, tx in zip(ins.index.tolist(), ins["us"], ins["value"], ins["tx_hash"]):
        while first < len(oi) and ou[first] < us:
            first += 1
        for k in range(first, len(oi)):
            if ou[k] - us > width:
                break
            if used[k] or (not same_tx and ot[k] == tx) or oa[k] * 1_000_000 < parts * value or (high <= 1 and oa[k] > value):
                continue
            used[k] = True
            pairs.append((i, oi[k]))
            break
    return pairs


def _matched(window: DataFrame, seconds: int, low: float, high: float, same_tx: bool) -> DataFrame:
    """Greedy pairs over all addresses: groups that have a pair in range at all go to the matcher."""
    near = onward(window, seconds)
    # a sieve in doubles, with a margin; the matcher decides on whole numbers
    ratio = F.col("out_amount").cast("double") / F.col("in_amount").cast("double")
    near = near.where(ratio.between(low - 1e-6, high + 1e-6) & (F.lit(same_tx) | (F.col("in_tx_hash") != F.col("out_tx_hash")))) if high < float("inf") else near
    groups = near.select("chain", "address", "asset").distinct()
    rows = window.where("amount > 0").select("chain", "address", "asset", "side", "tx_hash", "idx", F.col("amount").cast("decimal(38,0)").cast("string").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.join(groups, ["chain", "address", "asset"], "left_semi")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.reset_index(drop=True).assign(value=[int(v) for v in g["value"]])
        found = match_group(g, low, high, seconds * 1_000_000, same_tx)
        a, b = g.iloc[[i for i, _ in found]].reset_index(drop=True), g.iloc[[k for _, k in found]].reset_index(drop=True)
        return pd.DataFrame({
            "chain": a["chain"], "address": a["address"], "asset": a["asset"], "in_tx": a["tx_hash"], "out_tx": b["tx_hash"], "in_amount": a["value"].map(Decimal), "out_amount": b["value"].map(Decimal),
            "ratio": [y / x for x, y in zip(a["value"], b["value"])], "delay_us": (b["us"] - a["us"]).astype("int64"),
        })

    return rows.groupBy("chain", "address", "asset").applyInPandas(run, _PAIRS)


def sweep_pairs(window: DataFrame, seconds: int = 86_400, low: float = 0.95) -> DataFrame:
    """Receipts passed on nearly whole within a day, in another transaction; a send serves one receipt."""
    return _matched(window, seconds, low, 1.0, False)


def sweep_findings(pairs: DataFrame, seconds: int = 86_400) -> DataFrame:
    """A finding an address: strongest pair, count, average ratio, fastest, transactions of the top pairs."""
    delay = F.col("delay_us") / (seconds * 1e6)
    conf = F.least(0.55 + 0.30 * F.least(F.col("ratio"), F.lit(1.0)) + 0.10 * F.greatest(1 - delay, F.lit(0.0)), F.lit(0.95))
    w = Window.partitionBy("chain", "address").orderBy(F.desc("ratio"), "in_tx", "out_tx")
    best = F.max(F.struct("ratio", -F.col("delay_us"), conf.alias("c")))
    top = F.flatten(F.collect_list(F.when(F.col("place") <= 4, F.array("in_tx", "out_tx"))))
    out = pairs.withColumn("place", F.row_number().over(w)).groupBy("chain", "address").agg(
        F.count("*").alias("n_pairs"),
        F.bround(best["c"], 3).alias("confidence"),
        F.bround(F.avg("ratio"), 3).alias("avg_ratio"),
        F.min("delay_us").alias("fastest_us"),
        F.array_join(F.slice(F.array_sort(F.array_distinct(top)), 1, 8), ",").alias("refs"),
    )
    return out


def rapid_hops(window: DataFrame, seconds: int = 1800, least: int = 3) -> DataFrame:
    """Addresses that relay: receipts each followed by an unused send of the asset within half an hour."""
    pairs = _matched(window, seconds, 0.0, float("inf"), True)
    got = pairs.groupBy("chain", "address").agg(F.count("*").alias("n_pairs"), F.min("delay_us").alias("fastest_us")).where(F.col("n_pairs") >= least)
    return got.withColumn("strength", F.bround(F.least(F.col("n_pairs") / 9, F.lit(1.0)), 3))


def forgery_report(movements: DataFrame, least: int = 3) -> DataFrame:
    """By asset: movements, unverified ones, and amounts that ``least`` or more movements share exactly."""
    same = movements.groupBy("chain", "asset", "amount_str").agg(F.count("*").alias("n"), F.count_if(~F.col("verified")).alias("u"))
    return same.groupBy("chain", "asset").agg(F.sum("n").alias("n_movements"), F.sum("u").alias("n_unverified"), F.count_if(F.col("n") >= least).alias("n_sprayed_amounts"), F.max("n").alias("largest_spray"))


#: Detectors by name; a user adds a callable (window) -> findings.
REGISTRY = {"fan-in@1": fan_in, "distribution@1": distribution, "service@1": service_endpoint, "peel-chain@1": peel_chain, "rapid-hop@1": rapid_hops, "sweep@1": lambda w: sweep_findings(sweep_pairs(w))}
