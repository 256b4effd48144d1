"""Counterparties of addresses, spam-proof ranking, caps and the multi-case trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import SMALL_ROWS, materialize, sized_broadcast


def exposures(movements: DataFrame, direction: str, store: bool = False) -> DataFrame:
    """(chain, focus, counterparty, movement columns): who paid an address, or whom it paid.

    A half of an unspent-output transaction names one end only; the other side's halves of the
    same transaction stand in, once a transaction. An address is not its own counterparty. ``store``
    writes those stand-ins, for callers that read the rows level by level from stored movements.
    """
    focus, other = ("to_addr", "from_addr") if direction == "backward" else ("from_addr", "to_addr")
    keep = ["tx_hash", "idx", "asset", "verified", "amount", "amount_str", "ts"]
    direct = movements.where(F.col(focus).isNotNull() & F.col(other).isNotNull()).select("chain", F.col(focus).alias("focus"), F.col(other).alias("counterparty"), *keep)
    half = movements.where(F.col(focus).isNotNull() & F.col(other).isNull()).select("chain", "tx_hash", F.col(focus).alias("focus")).distinct()
    across = movements.where(F.col(focus).isNull() & F.col(other).isNotNull()).select("chain", F.col(other).alias("counterparty"), *keep)
    stood = half.join(across, ["chain", "tx_hash"]).select(*direct.columns)
    return direct.unionByName(materialize(stood, "exposures") if store else stood).where("focus <> counterparty")


def counterparties(movements: DataFrame, direction: str, by: tuple[str, ...] = ("chain", "focus"), more: Sequence[Column] = ()) -> DataFrame:
    """Per focus and counterparty: verified value, movements, the largest movement, and ``more`` aggregates of the same rows.

    Value counts evidence-grade assets only, so that worthless tokens cannot steer a ranking; a
    counterparty seen in others alone has value 0. A sum over 38 digits is null, not 0.
    """
    return _summed(exposures(movements, direction), by, *more)


def _summed(seen: DataFrame, by: tuple[str, ...], *more: Column) -> DataFrame:
    largest = F.struct(F.length("amount_str"), "amount_str", "ts", "tx_hash", "idx")
    graded = F.when(F.col("verified"), F.col("amount")).otherwise(F.lit(0).cast("decimal(38,0)"))
    # the struct travels once and is taken apart after the shuffle
    summed = seen.groupBy(*by, "counterparty").agg(F.try_sum(graded).alias("value"), F.count("*").alias("n_movements"), F.max(largest).alias("_l"), *more)
    return summed.withColumns({"largest_tx": F.col("_l.tx_hash"), "largest_amount": F.col("_l.amount_str")}).drop("_l")


def ranked(parties: DataFrame, by: tuple[str, ...] = ("chain", "focus")) -> DataFrame:
    """Rank by value, then address, and the number of counterparties of each focus."""
    w = Window.partitionBy(*by)
    return parties.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("value"), "counterparty"))).withColumn("n_parties", F.count("*").over(w))


def capped(parties: DataFrame, over: int = 50, keep: int = 20, by: tuple[str, ...] = ("chain", "focus")) -> DataFrame:
    """A focus with more than ``over`` counterparties keeps the ``keep`` largest; ``dropped`` counts the rest."""
    r = ranked(parties, by)
    large = F.col("n_parties") > over
    return r.where(~large | (F.col("rank") <= keep)).withColumn("dropped", F.when(large, F.col("n_parties") - keep).otherwise(0))


def cap_findings(movements: DataFrame, direction: str, over: int = 50, keep: int = 20, refs: int = 10) -> DataFrame:
    """A finding for each capped focus: dropped counterparties and the first sorted transactions."""
    seen = exposures(movements, direction)
    large = seen.groupBy("chain", "focus").agg(F.count_distinct("counterparty").alias("n_parties")).where(F.col("n_parties") > over)
    txs = seen.join(large, ["chain", "focus"]).select("chain", "focus", "n_parties", "tx_hash").distinct()
    w = Window.partitionBy("chain", "focus").orderBy("tx_hash")
    cut = txs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= refs)
    return cut.groupBy("chain", "focus", "n_parties").agg(F.array_join(F.array_sort(F.collect_list("tx_hash")), ",").alias("refs")).withColumn("dropped", F.col("n_parties") - keep)


DIRECTIONS = {"find_prev_vasp": "backward", "find_next_vasp": "forward"}


def expand_objectives(cases: DataFrame) -> DataFrame:
    """A row a case and direction: objectives named twice or unknown count once or not at all."""
    names = F.create_map(*[x for k, v in DIRECTIONS.items() for x in (F.lit(k), F.lit(v))])
    return cases.select("*", F.explode(F.array_distinct("objectives")).alias("objective")).withColumn("direction", F.element_at(names, F.col("objective"))).where("direction is not null")


def trace(
    cases: DataFrame,
    movements: DataFrame,
    closed: DataFrame | None = None,
    max_depth: int = 3,
    cap_over: int = 50,
    cap_keep: int = 20,
    max_nodes: int | None = None,
    max_opened: int | None = None,
    start: DataFrame | None = None,
    nodes_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Level-by-level expansion of many cases at once: (nodes, edges).

    ``cases`` has case_id, chain, root, direction. A level joins its frontier to the movements,
    ranks and caps counterparties, gives a new address its first parent by claim order (value
    descending, then address) and closes addresses of ``closed`` (chain, address, reason). An
    address reached before, or the root, gains an edge only. ``max_nodes`` and ``max_opened``
    cut a level in claim order, per case; what they cut is a node in state ``frontier``, which
    makes the coverage of its case incomplete; where ``max_nodes`` cut it, its reason says so and
    it was not admitted, so that it counts for no budget. Each level is written to the shared folder; the
    driver reads one count a level. ``start`` has the nodes of an earlier run: those it left at
    its depth or frontier go on, those it did not admit compete with what is found at their hop,
    and the others keep their state (see :func:`resume`). ``nodes_only`` gives no edges and does not
    write the last level, which is most of a deep trace: read such nodes once.

    nodes: case_id, chain, direction, address, hop, value, parent, tx_hash, state, reason,
    dropped; edges: case_id, chain, direction, src, dst, hop, value, tx_hash.
    """
    key = ["case_id", "chain", "direction"]
    null = F.lit(None)
    none, nothing = null.cast("string"), F.lit(0).cast("long")
    stop = None
    if closed is not None:
        stop = materialize(closed.groupBy("chain", "address").agg(F.min("reason").alias("reason")), "trace-closed")
        stop = sized_broadcast(stop, stop.count(), SMALL_ROWS)
    root = cases.select(*key, F.col("root").alias("address"), F.lit(0).alias("hop"), null.cast("decimal(38,0)").alias("value"), none.alias("parent"), none.alias("tx_hash"))
    edges: DataFrame | None = None
    # nodes with their state; each node is in one of these
    told: list[DataFrame] = []
    cut: DataFrame | None = None
    tell = lambda df, state, reason=F.col("reason"), dropped=nothing: told.append(df.select(*root.columns, state.alias("state"), reason.alias("reason"), dropped.alias("dropped")))
    if start is None:
        nodes = level = materialize(root.distinct(), "trace")
        pending = waiting = None
    else:
        unadmitted = F.col("state").eqNullSafe("frontier") & F.col("reason").eqNullSafe("max_nodes")
        nodes, waiting = start.where(~unadmitted).select(*root.columns), start.where(unadmitted).select(*root.columns)
        opens = F.coalesce(F.col("state").isin("frontier", "depth_horizon"), F.lit(False))
        pending = start.where(opens & ~unadmitted).select(*root.columns)
        tell(start.where(~opens), F.col("state"), dropped=F.col("dropped").cast("long"))
        tell(pending.where(F.col("hop") > max_depth), none, none, null.cast("long"))
        level = pending.where("hop = 0")
    opened = cases.select("case_id").distinct().withColumn("opened", F.lit(0).cast("long"))
    if start is not None:  # what an earlier run expanded is spent
        spent = start.where("state = 'expanded'").groupBy("case_id").agg(F.count("*").alias("opened"))
        opened = materialize(opened.select("case_id").join(spent, "case_id", "left").na.fill(0, ["opened"]), "trace-opened")
    feeds = {d: exposures(movements, d, store=True) for d in ("backward", "forward")}
    for hop in range(max_depth + 1):
        if pending is not None and hop:
            level = level.unionByName(pending.where(F.col("hop") == hop))
        now = level.withColumn("reason", none) if stop is None else level.join(stop, ["chain", "address"], "left")
        if hop == max_depth:
            # a label closes a branch where it is found; the root goes on
            tell(now, F.when(F.col("reason").isNotNull() & (F.col("hop") > 0), "closed").otherwise("depth_horizon"))
            break
        tell(now.where("reason is not null and hop > 0"), F.lit("closed"))
        going = now.where("reason is null or hop = 0")
        if max_opened is not None:
            w = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("value"), "address", "direction")
            going = going.join(opened, "case_id").withColumn("_n", F.row_number().over(w) + F.col("opened"))
            tell(going.where(F.col("_n") > max_opened), F.lit("frontier"))
            going = going.where(F.col("_n") <= max_opened).drop("_n", "opened")
        going = materialize(going, "trace-open")
        if max_opened is not None:
            opened = opened.join(going.groupBy("case_id").agg(F.count("*").alias("k")), "case_id", "left").select("case_id", (F.col("opened") + F.coalesce("k", F.lit(0))).alias("opened"))
            opened = materialize(opened, "trace-opened")
        # an address is summed and ranked once, however many cases open it; its movements, counterparties
        # and cases meet in one shuffle by address
        by = ("chain", "focus")
        asked = materialize(going.select("chain", "direction", F.col("address").alias("focus")).distinct(), "trace-asked")
        few = asked.count()
        found = None
        for d in ("backward", "forward"):
            here = F.col("direction") == d
            own = feeds[d].join(sized_broadcast(asked.where(here).select(*by), few, SMALL_ROWS), [*by], "left_semi")
            # the root's counterparties are never capped
            parties = capped(_summed(own, by), cap_over if hop else 1 << 60, cap_keep, by)
            part = going.where(here).select(*key, F.col("address").alias("focus"), F.col("value").alias("_pv")).join(parties, [*by])
            found = part if found is None else found.unionByName(part)
        found = found.select(*key, "focus", "counterparty", "value", "largest_tx", F.col("dropped").cast("long").alias("dropped"), "_pv")
        last = nodes_only and hop == max_depth - 1
        if not last:
            found = materialize(found, "trace-found")
            step = found.select(*key, F.col("focus").alias("src"), F.col("counterparty").alias("dst"), F.lit(hop + 1).alias("hop"), "value", F.col("largest_tx").alias("tx_hash"))
            edges = step if edges is None else edges.unionByName(step)
        lost = found.where("dropped > 0").select(*key, F.col("focus").alias("address"), "dropped").groupBy(*key, "address").agg(F.max("dropped").alias("_d"))
        tell(going.join(lost, [*key, "address"], "left"), F.lit("expanded"), dropped=F.coalesce("_d", nothing))
        w = Window.partitionBy(*key, "address").orderBy(F.desc_nulls_last("_pv"), "parent")
        fresh = found.select(*key, F.col("counterparty").alias("address"), F.lit(hop + 1).alias("hop"), "value", F.col("focus").alias("parent"), F.col("largest_tx").alias("tx_hash"), "_pv")
        fresh = fresh.join(nodes.select(*key, "address"), [*key, "address"], "left_anti").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_pv")
        if waiting is not None:  # what an earlier run found first keeps the parent it had
            then = waiting.where(F.col("hop") == hop + 1)
            fresh = then.unionByName(fresh.join(waiting.where(F.col("hop") <= hop + 1).select(*key, "address"), [*key, "address"], "left_anti"))
        if max_nodes is not None:
            have = nodes.groupBy("case_id").agg(F.count("*").alias("_have"))
            w = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("value"), "address", "direction")
            fresh = materialize(fresh.join(have, "case_id").withColumn("_cut", F.row_number().over(w) + F.col("_have") > max_nodes).drop("_have"), "trace-fresh")
            beyond = fresh.where("_cut").drop("_cut")
            cut = beyond if cut is None else cut.unionByName(beyond)
            fresh = fresh.where("not _cut").drop("_cut")
        level = fresh if last else materialize(fresh, "trace")
        nodes = nodes.unionByName(level)
        if not last and pending is None and level.isEmpty():
            break
    empty = cases.sparkSession.createDataFrame([], "case_id string, chain string, direction string, src string, dst string, hop int, value decimal(38,0), tx_hash string")
    if cut is not None:  # a node cut at several levels counts once, as first found
        w = Window.partitionBy(*key, "address").orderBy("hop", F.desc_nulls_last("value"), "parent")
        first = cut.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        tell(first.join(nodes.select(*key, "address"), [*key, "address"], "left_anti"), F.lit("frontier"), F.lit("max_nodes"))
    out = told[0]
    for part in told[1:]:
        out = out.unionByName(part)
    return out, empty if edges is None or nodes_only else edges


def resumable(cases: DataFrame) -> DataFrame:
    """Cases that may go on, and why others may not: only a partial run with allowance over what it spent."""
    why = F.when(F.col("status") != "partial", "not_partial").when(F.col("max_nodes") <= F.col("spent_nodes"), "spent")
    return cases.withColumn("refused", why)


def resume(nodes: DataFrame, edges: DataFrame, movements: DataFrame, closed: DataFrame | None = None, **budgets) -> tuple[DataFrame, DataFrame]:
    """An earlier run with larger budgets: (nodes, edges) of both runs together."""
    cases = nodes.where("hop = 0").select("case_id", "chain", F.col("address").alias("root"), "direction")
    more, new = trace(cases, movements, closed, start=materialize(nodes, "resume"), **budgets)
    return more, edges.unionByName(new)


def hop_profile(nodes: DataFrame) -> DataFrame:
    """Nodes by case, direction and hop, and growth over the hop before."""
    per = nodes.groupBy("case_id", "direction", "hop").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("state") == "closed").alias("n_closed"))
    w = Window.partitionBy("case_id", "direction").orderBy("hop")
    return per.withColumn("growth", F.try_divide(F.col("n_nodes").cast("double"), F.lag("n_nodes").over(w)))


def shortest_paths(nodes: DataFrame, max_depth: int) -> DataFrame:
    """(case_id, direction, address, hops, path): transactions from the root to each node, by discovery."""
    key = ["case_id", "chain", "direction"]
    done = nodes.where("hop = 0").select(*key, "address", F.array().cast("array<string>").alias("path"))
    out = done
    for hop in range(1, max_depth + 1):
        up = done.select(*key, F.col("address").alias("parent"), F.col("path").alias("_p"))
        done = nodes.where(F.col("hop") == hop).join(up, [*key, "parent"]).select(*key, "address", F.concat("_p", F.array("tx_hash")).alias("path"))
        out = out.unionByName(done)
    return out.withColumn("hops", F.size("path"))
