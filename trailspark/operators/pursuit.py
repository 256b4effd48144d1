"""Traces under budgets that are extended while a question is open, and that walk on past mixers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from . import mixers
from .counterparties import _summed, capped, exposures

KEY = ["case_id", "chain", "direction"]
NODE = [*KEY, "address", "hop", "value", "parent", "tx_hash", "basis", "reason"]
#: A position that no node has.
NEVER = 1 << 60
#: Reasons of a closing label: the one that answers a direction, and the one that is walked past.
NAMED, CROSSED = "vasp", "mixer"


@dataclass
class Pursuit:
    """nodes, edges and one row a case in ``stops`` (see :func:`pursue`)."""

    nodes: DataFrame
    edges: DataFrame
    stops: DataFrame


def pursue(
    cases: DataFrame,
    movements: DataFrame,
    closed: DataFrame,
    max_depth: int = 6,
    max_nodes: int = 500,
    max_extensions: int = 8,
    cap_over: int = 50,
    cap_keep: int = 20,
    days: int = 7,
    follow: int = 20,
) -> Pursuit:
    """Traces of many cases at once: first what value reached, then what lies past mixers.

    ``cases`` has case_id, chain, root, direction; ``closed`` has chain, address, reason. A node
    labelled ``vasp`` answers its direction where value led to it; one labelled ``mixer`` ends the
    traced branch. When no traced node is left to open, the exit ladder names candidates for every
    traced mixer by the event through which the trace came, at most ``follow`` a mixer, and these
    are nodes with a ``basis``, one hop on. Nodes found from them inherit it; a second crossing
    names its own. An address that value reached is never such a node, nor is the root, and such a
    node answers nothing. So traced nodes come before leads, and a traced discovery wins.

    Nodes are admitted in claim order: hop, value descending, address, direction. A case has an
    allowance of ``max_nodes`` nodes, roots included (never less than its roots). When it is used
    up and work is left, it grows by ``max_nodes`` while a direction has no answer and fewer than
    ``max_extensions`` were granted; else the case stops, by itself. A level finds how many
    extensions each case needs from positions in claim order; the driver reads one emptiness a level.

    nodes: case_id, chain, direction, address, hop, value, parent, tx_hash, basis (null where
    value led), reason, state (``expanded``, ``closed``, ``depth_horizon``, or ``frontier`` for what
    was not admitted or not opened; ``admitted`` tells which). edges: src, dst, hop, value, tx_hash,
    crossing. stops: case_id, allowance, granted, have, unanswered, stop: ``answered``, ``ceiling``,
    ``frontier_empty`` (used up, nothing left, a direction open) or ``completed``.

    Null roots and directions other than backward and forward have no case; repeated cases and
    labels count once; movements with a null end have no counterparty but through their
    transaction. Empty tables give empty results, extra columns are ignored.
    """
    run = _Run(cases, movements, closed, max_depth, max_nodes, max_extensions, cap_over, cap_keep)
    level = run.roots
    for hop in range(max_depth):
        level = run.admit(run.discoveries(level, hop), max_depth, waiting=True)
        if level.isEmpty():
            break
    leads = run.admit(run.crossings(run.nodes(), days, follow, max_depth), max_depth)
    level = None
    if not leads.isEmpty():
        for hop in range(2, max_depth):
            here = leads.where(F.col("hop") == hop)
            here = here if level is None else here.unionByName(level)
            if here.isEmpty():
                continue
            later = leads.where((F.col("hop") > hop) & (F.col("hop") < max_depth)).groupBy("case_id").agg(F.count("*").alias("_later"))
            found = run.discoveries(here, hop).unionByName(run.crossings(here, days, follow, max_depth))
            level = run.admit(_first(found), max_depth, later=later)
    return run.result(max_depth)


def _first(found: DataFrame) -> DataFrame:
    """One row an address: the least hop, then the parent of the greatest value, a movement before a crossing."""
    w = Window.partitionBy(*KEY, "address").orderBy("hop", F.desc_nulls_last("_pv"), "parent", F.col("_crossing"), F.desc_nulls_last("value"), "tx_hash")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class _Run:
    """The tables that grow from level to level; each is written to the shared folder."""

    def __init__(self, cases, movements, closed, max_depth, max_nodes, max_extensions, cap_over, cap_keep):
        self.base, self.most, self.cap = max_nodes, max_extensions, (cap_over, cap_keep)
        self.movements = movements
        asked = cases.where("case_id is not null and root is not null and direction in ('backward', 'forward')").select(*KEY, "root").distinct()
        # nothing, as a column, of every kind
        none = {c: F.lit(None).cast(t).alias(c) for c, t in (("value", "decimal(38,0)"), ("parent", "string"), ("tx_hash", "string"), ("basis", "string"), ("reason", "string"))}
        self.roots = materialize(asked.select(*KEY, F.col("root").alias("address"), F.lit(0).alias("hop"), *none.values()).distinct(), "pursuit-roots")
        self.stop_labels = materialize(closed.where("address is not null").groupBy("chain", "address").agg(F.min("reason").alias("reason")), "pursuit-closed")
        # the movements are stored by the caller: only what stands in for a missing end is written
        self.feeds = {d: exposures(movements, d, store=True) for d in ("backward", "forward")}
        state = self.roots.groupBy("case_id").agg(F.count("*").alias("have"), F.array_sort(F.collect_set("direction")).alias("unanswered"))
        self.state = materialize(state.select("case_id", "have", F.greatest(F.lit(max_nodes).cast("long"), "have").alias("allowance"), F.lit(0).cast("long").alias("granted"), "unanswered", F.lit(None).cast("string").alias("stop"), F.lit(0).cast("long").alias("waiting")), "pursuit-state")
        self.admitted, self.cut, self.edges, self.opened = [self.roots], [], [], []
        self.events: DataFrame | None = None

    def nodes(self) -> DataFrame:
        """All admitted nodes."""
        out = self.admitted[0]
        for part in self.admitted[1:]:
            out = out.unionByName(part)
        return out

    def going(self) -> DataFrame:
        return self.state.where("stop is null").select("case_id")

    def _new(self, found: DataFrame) -> DataFrame:
        known = self.nodes().select(*KEY, "address")
        roots = self.roots.select("case_id", "chain", "address").distinct()
        return found.join(known, [*KEY, "address"], "left_anti").join(roots, ["case_id", "chain", "address"], "left_anti")

    def discoveries(self, level: DataFrame, hop: int) -> DataFrame:
        """Counterparties of a level's open nodes that their case does not know, and all edges to them.

        An address is summed and ranked once, however many cases opened it.
        """
        open_ = level.where("reason is null or hop = 0").join(self.going(), "case_id", "left_semi")
        open_ = materialize(open_, "pursuit-open")
        self.opened.append(open_.select(*KEY, "address"))
        asked = open_.select("chain", "direction", F.col("address").alias("focus")).distinct()
        by = ("chain", "direction", "focus")
        seen = None
        for d, feed in self.feeds.items():
            part = asked.where(F.col("direction") == d).join(feed, ["chain", "focus"])
            seen = part if seen is None else seen.unionByName(part)
        summed = _summed(seen, by)
        parties = capped(summed, *self.cap, by) if hop else summed  # a root's counterparties are never cut
        found = open_.select(*KEY, F.col("address").alias("focus"), F.col("value").alias("_pv"), "basis").join(parties.select("chain", "direction", "focus", "counterparty", "value", "largest_tx"), ["chain", "direction", "focus"])
        found = materialize(found.select(*KEY, F.col("counterparty").alias("address"), F.lit(hop + 1).alias("hop"), "value", F.col("focus").alias("parent"), F.col("largest_tx").alias("tx_hash"), "basis", "_pv", F.lit(False).alias("_crossing")), "pursuit-found")
        self._tell(found)
        return _first(self._new(found))

    def _tell(self, found: DataFrame) -> None:
        self.edges.append(found.select(*KEY, F.col("parent").alias("src"), F.col("address").alias("dst"), "hop", "value", "tx_hash", F.col("_crossing").alias("crossing")))

    def crossings(self, level: DataFrame, days: int, follow: int, max_depth: int) -> DataFrame:
        """Exit candidates of a level's mixers that their case does not know, one hop past the mixer."""
        arrived = level.where((F.col("reason") == CROSSED) & (F.col("hop") > 0) & (F.col("hop") < max_depth)).join(self.going(), "case_id", "left_semi")
        arrived = materialize(arrived.select(*KEY, F.col("address").alias("mixer"), F.col("parent").alias("party"), "hop", F.col("value").alias("_pv")), "pursuit-arrived")
        empty = arrived.select(*KEY, F.col("mixer").alias("address"), "hop", F.col("_pv").alias("value"), F.col("mixer").alias("parent"), F.lit("").alias("tx_hash"), F.lit("").alias("basis"), "_pv", F.lit(True).alias("_crossing")).where("false")
        if arrived.isEmpty():
            return empty
        if self.events is None:
            self.events = materialize(mixers.activity(self.movements, self.stop_labels.where(F.col("reason") == CROSSED)), "pursuit-events")
        out = None
        names = F.create_map(*[F.lit(x) for k, (n, _) in mixers.RUNGS.items() for x in (k, n)])
        for d in ("backward", "forward"):
            came = arrived.where(F.col("direction") == d)
            anchor = materialize(mixers.anchors(self.events, d).join(came.select("chain", "mixer", "party").distinct(), ["chain", "mixer", "party"], "left_semi"), "pursuit-anchors")
            party = anchor.select("chain", "party").distinct()
            # the ladder asks movements for dealings of the anchors' parties alone
            ends = [self.movements.join(party.withColumnRenamed("party", c), ["chain", c], "left_semi").select("chain", "from_addr", "to_addr") for c in ("from_addr", "to_addr")]
            ladder = mixers.exits(materialize(ends[0].unionByName(ends[1]), "pursuit-dealings"), self.events, anchor, d, days, follow)
            w = Window.partitionBy("chain", "mixer", "party").orderBy(F.desc("confidence"), "far")
            ladder = ladder.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= follow)
            part = came.join(ladder, ["chain", "mixer", "party"]).select(*KEY, F.col("far").alias("address"), (F.col("hop") + 1).alias("hop"), F.col("far_amount").alias("value"), F.col("mixer").alias("parent"), F.col("far_tx").alias("tx_hash"), F.element_at(names, F.col("rung")).alias("basis"), "_pv", F.lit(True).alias("_crossing"))
            # one ladder a job: the plan of both together is what the driver holds most of
            part = materialize(part, "pursuit-crossed")
            out = part if out is None else out.unionByName(part)
        known = self.nodes().where("basis is null").select(*KEY, "address")
        roots = self.roots.select("case_id", "chain", "address").distinct()
        # no edge of a guess leads to an address that value reached, or to the root
        self._tell(out.join(known, [*KEY, "address"], "left_anti").join(roots, ["case_id", "chain", "address"], "left_anti"))
        return _first(self._new(out))

    def admit(self, fresh: DataFrame, max_depth: int, waiting: bool = False, later: DataFrame | None = None) -> DataFrame:
        """The part of a level that allowances admit, after the extensions that its cases need and may have."""
        fresh = fresh.join(self.stop_labels, ["chain", "address"], "left")
        w = Window.partitionBy("case_id").orderBy("hop", F.desc_nulls_last("value"), "address", "direction")
        ranked = fresh.join(self.state.select("case_id", "have"), "case_id").withColumn("_pos", F.row_number().over(w) + F.col("have")).select(*NODE, "_pos")
        ranked = materialize(ranked, "pursuit-ranked")
        opens = (F.col("hop") < max_depth) & (F.col("reason").isNull() | (F.col("reason") == CROSSED))
        named = (F.col("reason") == NAMED) & F.col("basis").isNull()
        per = ranked.groupBy("case_id").agg(
            F.count("*").alias("_n"), F.count_if(opens).alias("_open"), F.count_if((F.col("reason") == CROSSED) & (F.col("hop") < max_depth)).alias("_mix"),
            F.min(F.when(named & (F.col("direction") == "backward"), F.col("_pos"))).alias("_backward"), F.min(F.when(named & (F.col("direction") == "forward"), F.col("_pos"))).alias("_forward"),
        )
        s = self.state.join(per, "case_id", "left")
        s = s.withColumn("_later", F.lit(0)) if later is None else s.join(later, "case_id", "left")
        s = s.na.fill(0, ["_n", "_open", "_mix", "_later"])
        at = lambda d: F.coalesce(F.when(d == "backward", F.col("_backward")).when(d == "forward", F.col("_forward")), F.lit(NEVER))
        # where the last open direction gets its answer, in claim order
        s = s.withColumn("_at", F.coalesce(F.array_max(F.transform("unanswered", at)), F.lit(0)))
        over = F.col("have") + F.col("_n") - F.col("allowance")
        work = F.col("_open") + F.col("_later") + (F.col("waiting") if waiting else F.lit(0))
        used_up = F.floor(over / self.base) + 1 - ((over % self.base == 0) & (work == 0)).cast("long")
        s = s.withColumn("_used_up", F.when((over < 0) | F.col("stop").isNotNull(), 0).otherwise(used_up))
        wanted = F.greatest(F.lit(0), F.ceil((F.col("_at") - F.col("allowance")) / self.base))
        s = s.withColumn("_more", F.least(F.col("_used_up"), F.lit(self.most) - F.col("granted"), wanted).cast("long"))
        s = s.withColumn("allowance", F.col("allowance") + F.col("_more") * self.base).withColumn("granted", F.col("granted") + F.col("_more"))
        ends = F.when(F.col("_used_up") > F.col("_more"), F.when(F.col("_at") <= F.col("allowance"), "answered").otherwise("ceiling"))
        s = s.select(
            "case_id", F.least(F.col("have") + F.col("_n"), F.greatest("have", "allowance")).alias("have"), "allowance", "granted",
            F.filter("unanswered", lambda d: at(d) > F.col("allowance")).alias("unanswered"), F.coalesce("stop", ends).alias("stop"), (F.col("waiting") + F.col("_mix")).alias("waiting"),
        )
        self.state = materialize(s, "pursuit-state")
        placed = ranked.join(self.state.select("case_id", "allowance"), "case_id").withColumn("_in", F.col("_pos") <= F.col("allowance")).drop("allowance", "_pos")
        self.cut.append(placed.where("not _in").drop("_in"))
        level = materialize(placed.where("_in").drop("_in"), "pursuit-level")
        self.admitted.append(level)
        return level

    def result(self, max_depth: int) -> Pursuit:
        opened = self.opened[0]
        for part in self.opened[1:]:
            opened = opened.unionByName(part)
        lost = self.cut[0]
        for part in self.cut[1:]:
            lost = lost.unionByName(part)
        edges = self.edges[0]
        for part in self.edges[1:]:
            edges = edges.unionByName(part)
        nodes = self.nodes().join(opened.distinct().withColumn("_o", F.lit(True)), [*KEY, "address"], "left")
        state = F.when((F.col("hop") > 0) & F.col("reason").isNotNull(), "closed").when(F.col("_o"), "expanded").when(F.col("hop") >= max_depth, "depth_horizon").otherwise("frontier")
        nodes = nodes.select(*NODE, state.alias("state"), F.lit(True).alias("admitted"))
        # what several levels cut counts once, as first found
        w = Window.partitionBy(*KEY, "address").orderBy("hop", F.col("basis").isNotNull(), F.desc_nulls_last("value"), "parent", "basis")
        lost = lost.withColumn("_r", F.row_number().over(w)).where("_r = 1").join(self.nodes().select(*KEY, "address"), [*KEY, "address"], "left_anti")
        nodes = nodes.unionByName(lost.select(*NODE, F.lit("frontier").alias("state"), F.lit(False).alias("admitted")))
        full = F.when(F.col("have") >= F.col("allowance"), F.when(F.size("unanswered") == 0, "answered").otherwise("frontier_empty")).otherwise("completed")
        return Pursuit(nodes, edges.distinct(), self.state.select("case_id", "allowance", "granted", "have", "unanswered", F.coalesce("stop", full).alias("stop")))


#: What a category of label amounts to on a node.
KINDS = {"vasp": "vasp_endpoint", "mixer": "mixer_exposure", "sanctioned": "sanctions_exposure"}


def stamped_findings(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings of active labels on admitted nodes, every one past a mixer stamped with its basis.

    (case_id, direction, address, hop, kind, entity, confidence, speculative, basis, summary): the
    surest claim of each kind. A stamped summary says that the address may be an unrelated party's.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    claims = labels.where(F.col("status") == "active").withColumn("kind", F.element_at(kinds, F.col("category"))).where("kind is not null")
    claims = claims.groupBy("chain", "address", "kind").agg(F.max(F.struct("confidence", "entity")).alias("c"))
    out = nodes.where("admitted and hop > 0").join(claims, ["chain", "address"])
    past = F.concat(F.lit("; past a mixer by "), "basis", F.lit(", may be an unrelated party's"))
    said = F.concat("kind", F.lit(" "), "c.entity", F.coalesce(past, F.lit("")))
    return out.select("case_id", "direction", "address", "hop", "kind", "c.entity", "c.confidence", F.col("basis").isNotNull().alias("speculative"), "basis", said.alias("summary"))
