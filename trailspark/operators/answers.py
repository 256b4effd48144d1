"""Answers and report tables: nearest endpoints, coverage, caveats, summaries of addresses, transactions and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CASE = ["case_id", "direction"]


def endpoint_findings(nodes: DataFrame, labels: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Findings with the hop of their node: labelled services by their claims, and unnamed service-like hubs."""
    active = labels.where("status = 'active' and category = 'vasp'").groupBy("chain", "address").agg(F.max(F.struct("confidence", "entity", "source")).alias("c"))
    out = nodes.where("hop > 0").join(active, ["chain", "address"]).select("case_id", "direction", "chain", "address", "hop", F.lit(True).alias("named"), F.col("c.entity").alias("entity"), F.col("c.confidence").alias("confidence"), F.lit("third_party_claim").alias("basis"))
    if services is None:
        return out
    hub = nodes.where("hop > 0").join(services.select("chain", "address", F.col("confidence").alias("k")), ["chain", "address"]).join(active.select("chain", "address"), ["chain", "address"], "left_anti")
    return out.unionByName(hub.select("case_id", "direction", "chain", "address", "hop", F.lit(False).alias("named"), F.lit(None).cast("string").alias("entity"), F.col("k").alias("confidence"), F.lit("heuristic_inference").alias("basis")))


def nearest(findings: DataFrame, *order) -> DataFrame:
    """The first finding of each case and direction; ties end at the address."""
    w = Window.partitionBy(*CASE).orderBy(*order, "address", "entity")
    return findings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def direction_answers(findings: DataFrame, speculative: DataFrame | None = None) -> DataFrame:
    """Per case and direction: nearest endpoint, nearest named one, and a lead where there is neither.

    On a tie of hops the unnamed finding is preferred as the nearest; a lead comes from
    speculative findings and only where nothing was traced.
    """
    a = nearest(findings, "hop", "named", F.desc("confidence")).select(*CASE, F.col("address").alias("nearest"), F.col("hop").alias("nearest_hop"), F.col("named").alias("nearest_named"))
    b = nearest(findings.where("named"), "hop", F.desc("confidence")).select(*CASE, F.col("address").alias("named_address"), F.col("entity").alias("named_entity"), F.col("hop").alias("named_hop"))
    out = a.join(b, CASE, "left")
    if speculative is not None:
        c = nearest(speculative, "hop", F.desc("named"), F.desc("confidence")).select(*CASE, F.col("address").alias("lead"), F.col("hop").alias("lead_hop"))
        out = out.join(c, CASE, "full").withColumn("lead", F.when(F.col("nearest").isNull(), F.col("lead"))).withColumn("lead_hop", F.when(F.col("nearest").isNull(), F.col("lead_hop")))
    return out


def speculative_stamp(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings past a mixer crossing, marked with the basis of the weakest step; traced ones have none."""
    basis = candidates.groupBy("chain", F.col("far").alias("address")).agg(F.min_by("speculative_basis", F.struct("confidence", "speculative_basis")).alias("basis_of_crossing"))
    return findings.join(basis, ["chain", "address"], "left").withColumn("speculative", F.col("basis_of_crossing").isNotNull())


def case_report(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a case and direction: root, addresses reached, verdict, nearest named entity."""
    per = nodes.groupBy(*CASE).agg(F.count("*").alias("reached"), F.max(F.when(F.col("hop") == 0, F.col("address"))).alias("root"))
    return per.join(verdicts(answers), CASE, "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def verdicts(answers: DataFrame) -> DataFrame:
    """What a direction amounts to: named, unnamed, lead or none."""
    lead = F.col("lead").isNotNull() if "lead" in answers.columns else F.lit(False)
    return answers.withColumn("verdict", F.when(F.col("named_address").isNotNull(), "named").when(F.col("nearest").isNotNull(), "unnamed").when(lead, "lead").otherwise("none"))


def claim_entity(summary):
    """(subject, entity) of a claim's sentence ``<subject> labeled '<entity>'``; nulls if it is none."""
    pattern = r"^(.+?) labeled '([^']+)'$"
    get = lambda i: F.nullif(F.regexp_extract(summary, pattern, i), F.lit(""))
    return F.struct(get(1).alias("subject"), get(2).alias("entity"))


def coverage_counters(nodes: DataFrame) -> DataFrame:
    """One conditional aggregate a case: reached, opened, closed, depth stops, frontier, capped, complete."""
    n = lambda c: F.count_if(c)
    out = nodes.groupBy("case_id").agg(
        F.count("*").alias("reached"), n(F.col("state") == "expanded").alias("opened"), n(F.col("state") == "closed").alias("closed"), n(F.col("state") == "depth_horizon").alias("depth_stops"),
        n(F.col("state") == "frontier").alias("frontier"), n(F.col("reason") == "mixer").alias("mixer_stops"), n(F.col("dropped") > 0).alias("capped"), F.sum(F.coalesce("dropped", F.lit(0))).alias("dropped"),
    )
    return out.withColumn("complete", (F.col("depth_stops") == 0) & (F.col("frontier") == 0) & (F.col("capped") == 0))


def caveats(coverage: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, code, n): what a reader has to know; a case without any gap says so, so none is empty."""
    codes = {"depth_horizon": "depth_stops", "budget_frontier": "frontier", "mixer_stop": "mixer_stops", "capped_counterparties": "dropped"}
    each = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.struct(F.lit(k).alias("code"), F.col(c).cast("long").alias("n"))) for k, c in codes.items()]))
    gaps = coverage.select("case_id", F.explode(each).alias("x")).select("case_id", "x.code", "x.n")
    unnamed = answers.where("nearest is not null and named_address is null").groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("unnamed_endpoint").alias("code"), "n")
    both = gaps.unionByName(unnamed)
    none = coverage.select("case_id").join(both.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("no_gap").alias("code"), F.lit(0).cast("long").alias("n"))
    return both.unionByName(none)


def claim_ages(labels: DataFrame, today: str, stale_days: int = 365) -> DataFrame:
    """Claims with their age in days and state: undated, future, stale or fresh."""
    age = F.datediff(F.lit(today).cast("date"), F.col("source_date"))
    return labels.withColumn("age_days", age).withColumn("age_state", F.when(age.isNull(), "undated").when(age < 0, "future").when(age >= stale_days, "stale").otherwise("fresh"))


EVIDENCE_ORDER = ("onchain_fact", "third_party_claim", "heuristic_inference", "engine_observation")


def ordered_evidence(evidence):
    """Evidence structs in reading order of their kinds, each kind in the order given."""
    of = lambda kind: F.filter(evidence, lambda e: e["kind"] == kind)
    return F.concat(*map(of, EVIDENCE_ORDER))


def shortfall(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """By case and direction of ``expected``: found a named endpoint, an unnamed one only, or none."""
    per = findings.groupBy(*CASE).agg(F.bool_or("named").alias("named"))
    out = expected.select(*CASE).distinct().join(per, CASE, "left")
    return out.withColumn("outcome", F.when(F.col("named").isNull(), "none").when(F.col("named"), "named").otherwise("unnamed_only")).drop("named")


def quota_graph(nodes: DataFrame, pinned: DataFrame, per_level: int = 20, limit: int | None = None) -> DataFrame:
    """Nodes of a case's export: the top of each level by value, pinned ones, and their ancestors.

    tier 0 pinned, 1 ancestors, 2 level quota. Ancestors follow discovery parents, one join a
    level at most, over kept nodes only.
    """
    key = ["case_id", "chain", "direction"]
    w = Window.partitionBy("case_id", "direction", "hop").orderBy(F.desc_nulls_last("value"), "address")
    top = nodes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_level).select(*key, "address", "hop", F.lit(2).alias("tier"))
    pin = nodes.join(pinned.select("chain", "address").distinct(), ["chain", "address"], "left_semi").select(*key, "address", "hop", "parent")
    out = top.unionByName(pin.select(*key, "address", "hop", F.lit(0).alias("tier")))
    depth = nodes.agg(F.max("hop")).first()[0] or 0
    up = pin
    for _ in range(depth):
        up = nodes.join(up.where("parent is not null").select(*key, F.col("parent").alias("address")).distinct(), [*key, "address"], "left_semi").select(*key, "address", "hop", "parent")
        out = out.unionByName(up.select(*key, "address", "hop", F.lit(1).alias("tier")))
    out = out.groupBy(*key, "address", "hop").agg(F.min("tier").alias("tier"))
    if limit is None:
        return out
    w = Window.partitionBy("case_id").orderBy("tier", "hop", "address", "direction")
    total = F.count("*").over(Window.partitionBy("case_id"))
    return out.withColumn("total", total).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).withColumn("truncated", F.col("total") > limit).drop("_r")


def edge_export(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose both ends an export keeps."""
    key = ["case_id", "chain", "direction"]
    end = lambda c: kept.select(*key, F.col("address").alias(c)).distinct()
    return edges.join(end("src"), [*key, "src"], "left_semi").join(end("dst"), [*key, "dst"], "left_semi")


def address_summary(sides: DataFrame, recent: int = 10) -> DataFrame:
    """By address: funded, spent, balance, transactions, and the newest transactions with their direction.

    A transaction is ``in`` when an address received at least what it sent in it.
    """
    side = lambda s: F.when(F.col("side") == s, F.col("amount")).otherwise(F.lit(0).cast("decimal(38,0)"))
    per = sides.groupBy("chain", "address", "tx_hash").agg(F.try_sum(side("in")).alias("got"), F.try_sum(side("out")).alias("paid"), F.max("ts").alias("ts"))
    w = Window.partitionBy("chain", "address").orderBy(F.desc("ts"), "tx_hash")
    last = per.withColumn("_r", F.row_number().over(w))
    told = F.when(F.col("_r") <= recent, F.struct("_r", F.concat_ws(":", "tx_hash", F.when(F.col("got") >= F.col("paid"), "in").otherwise("out")).alias("t")))
    list_ = F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), ",")
    out = last.groupBy("chain", "address").agg(F.try_sum("got").alias("funded"), F.try_sum("paid").alias("spent"), F.count("*").alias("n_txs"), list_.alias("recent"))
    return out.withColumn("balance", F.try_subtract("funded", "spent"))


def tx_summary(txs: DataFrame) -> DataFrame:
    """Of unspent-output transactions: inputs, outputs, fee (0 for coinbase), replaceable, witness, virtual size."""
    total = lambda a, v: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(v(x), F.lit(0)))
    coinbase = F.exists("vin", lambda i: F.coalesce(i["is_coinbase"], F.lit(False)))
    got, paid = total("vin", lambda i: i["prevout"]["value"]), total("vout", lambda o: o["value"])
    note = F.array_join(F.transform(F.filter("vout", lambda o: o["scriptpubkey_type"] == "op_return"), lambda o: o["scriptpubkey_asm"]), " ")
    return txs.select(
        "txid", got.alias("value_in"), paid.alias("value_out"), F.when(coinbase, F.lit(0).cast("long")).otherwise(got - paid).alias("fee"), F.exists("vin", lambda i: F.coalesce(i["sequence"] < 0xFFFFFFFE, F.lit(False))).alias("replaceable"),
        F.exists("vin", lambda i: F.coalesce(F.size(i["witness"]) > 0, F.lit(False))).alias("witness"), F.ceil(F.col("weight") / 4).alias("vsize"), note.alias("note"),
    )


def block_summary(movements: DataFrame, sample: int = 12) -> DataFrame:
    """By block: transactions, movements, value, and the first transactions by hash."""
    txs = movements.groupBy("chain", "block", "tx_hash").agg(F.count("*").alias("n"), F.try_sum("amount").alias("v"))
    w = Window.partitionBy("chain", "block").orderBy("tx_hash")
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= sample, F.col("tx_hash")))), ",")
    return txs.withColumn("_r", F.row_number().over(w)).groupBy("chain", "block").agg(F.count("*").alias("n_txs"), F.sum("n").alias("n_movements"), F.try_sum("v").alias("value"), first.alias("sample"))


def feed_metrics(calls: DataFrame) -> DataFrame:
    """By provider and capability: calls, success rate, nearest-rank p50 and p95, largest latency, fallbacks, cache hits."""
    w = Window.partitionBy("provider", "capability")
    r = calls.withColumn("_i", F.row_number().over(w.orderBy("latency_ms", "call_id")) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda f: F.max(F.when(F.col("_i") == F.bround(f * (F.col("_n") - 1), 0).cast("long"), F.col("latency_ms")))
    return r.groupBy("provider", "capability").agg(
        F.count("*").alias("n_calls"), F.bround(F.avg(F.col("ok").cast("double")), 6).alias("success"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("latency_ms").alias("slowest"), F.count_if("fallback").alias("fallbacks"), F.count_if("cached").alias("cached")
    )


def ego_links(sides: DataFrame, per_side: int = 16) -> DataFrame:
    """Links of the ego graph of every address: its counterparts by side, largest value first."""
    per = sides.where("other is not null and other <> address").groupBy("chain", "address", "side", "other").agg(F.try_sum("amount").alias("amount"), F.count("*").alias("n"))
    w = Window.partitionBy("chain", "address", "side").orderBy(F.desc("amount"), "other")
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_side)


def tx_graph(halves: DataFrame, per_side: int = 12) -> DataFrame:
    """Nodes around transactions: inputs at level -1, outputs at level 1, the first ``per_side`` of each."""
    level = F.when(F.col("kind") == "utxo_input", -1).otherwise(1)
    w = Window.partitionBy("chain", "tx_hash", "level").orderBy("idx", "dedup_key")
    rows = halves.withColumn("level", level).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_side)
    return rows.select("chain", "tx_hash", F.coalesce("from_addr", "to_addr").alias("address"), "level", "place", "amount")


def signed_levels(nodes: DataFrame) -> DataFrame:
    """Levels for drawing: sources below zero, destinations above, stacked by address within a level.

    An address reached both ways keeps the nearer; the source side wins a tie.
    """
    level = F.when(F.col("direction") == "backward", -F.col("hop")).otherwise(F.col("hop"))
    one = nodes.groupBy("case_id", "address").agg(F.min(F.struct("hop", level.alias("level"))).alias("x")).select("case_id", "address", F.col("x.level").alias("level"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "level").orderBy("address")))
