"""Registered queries of fact maintenance, counterparties, traces and knowledge joins."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answers, counterparties as cp, facts, knowledge, paths
from ..runtime import fit_partitions, materialize
from .views import labels, movements, raw_movements, sql, table, utxo_halves

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, oracle: str | None = None, raw: str | None = None):
    """Register a query with its DuckDB oracle: over the ledger views, or ``raw`` over the plain tables.

    Its shuffles start with as many partitions as the ledger needs (a count from file footers).
    """

    def add(f):
        @wraps(f)
        def sized(spark: SparkSession, d: str) -> DataFrame:
            fit_partitions(spark, table(spark, d, "lineitem").count())
            return f(spark, d)

        Q[name] = sized
        if oracle is not None:
            S[name] = sql(oracle)
        if raw is not None:
            S[name] = raw
        return f

    return add


def long(c: str):
    """A 38-digit amount as a long for results; views hold amounts far below its range."""
    return F.col(c).cast("bigint").alias(c)


# ---------------------------------------------------------------- facts
@query("b1_first_write", "SELECT tx_hash, dedup_key, from_addr, to_addr, asset, verified, amount, ts, gas_price, provider, retrieved_at FROM mv")
def b1(spark: SparkSession, d: str) -> DataFrame:
    """Stored movements: the first write of each key."""
    return movements(spark, d).select("tx_hash", "dedup_key", "from_addr", "to_addr", "asset", "verified", long("amount"), "ts", long("gas_price"), "provider", "retrieved_at")


@query("b1_new_rows", "old AS (SELECT * FROM mv WHERE provider = 'F') SELECT tx_hash, dedup_key, amount FROM mv WHERE (tx_hash, dedup_key) NOT IN (SELECT (tx_hash, dedup_key) FROM old)")
def b1n(spark, d):
    """What a batch adds to a store that has the rows of one feed."""
    mv = movements(spark, d)
    return facts.new_rows(mv, mv.where("provider = 'F'")).select("tx_hash", "dedup_key", long("amount"))


@query("b2_new_addresses", """e AS (SELECT chain, to_addr AS address, asset, retrieved_at, tx_hash, dedup_key, idx FROM mv UNION ALL SELECT chain, from_addr, asset, retrieved_at, tx_hash, dedup_key, idx FROM mv)
SELECT address, asset AS first_asset FROM e WHERE idx > 1 AND address NOT IN (SELECT address FROM e WHERE idx = 1)
QUALIFY row_number() OVER (PARTITION BY address ORDER BY retrieved_at, tx_hash, dedup_key) = 1""")
def b2(spark, d):
    """Addresses that later lines add, with the asset they were first seen with."""
    e = facts.sides(movements(spark, d)).withColumn("at", F.struct("retrieved_at", "tx_hash", "dedup_key")).withColumn("first_asset", F.col("asset"))
    return facts.new_dimension(e.where("idx > 1"), e.where("idx = 1"), ["chain", "address"], "at", ["first_asset"]).select("address", "first_asset")


@query("b3_evidence_grade", "SELECT asset, count(*) AS n, count(*) FILTER (asset IN ('N', 'A')) AS graded, count(*) FILTER (asset = 'R') AS excluded FROM mv GROUP BY asset")
def b3(spark, d):
    """Movements by asset that may rank and feed detectors: native, or of a verified contract."""
    mv = movements(spark, d).withColumn("asset_kind", F.when(F.col("asset") == "N", "native").otherwise("token")).withColumn("contract", F.when(F.col("asset") != "N", F.col("asset")))
    verified = mv.where("asset = 'A'").select("chain", "contract").distinct()
    return facts.graded(mv, verified).groupBy("asset").agg(F.count("*").alias("n"), F.count_if("graded").alias("graded"), F.count_if(~F.col("graded")).alias("excluded"))


@query("b4_gas_backfill", """p AS (SELECT tx_hash, min(gas_price) AS g FROM raw WHERE gas_price IS NOT NULL GROUP BY tx_hash)
SELECT mv.tx_hash, dedup_key, coalesce(gas_price, g) AS gas_price, gas_price IS NULL AND g IS NOT NULL AS changed FROM mv LEFT JOIN p ON mv.tx_hash = p.tx_hash""")
def b4(spark, d):
    """Null gas prices filled once from other rows of the transaction."""
    out = facts.backfill(movements(spark, d), raw_movements(spark, d), ["chain", "tx_hash"])
    return out.select("tx_hash", "dedup_key", long("gas_price"), "changed")


@query("b5_directional_read", """SELECT to_addr AS address, tx_hash, idx, row_number() OVER (PARTITION BY to_addr ORDER BY ts DESC, tx_hash, idx) AS place FROM mv QUALIFY place <= 5""")
def b5(spark, d):
    """The newest five receipts of every address."""
    return facts.directional_read(movements(spark, d), "backward", 5).select("address", "tx_hash", "idx", F.col("place").cast("long").alias("place"))


@query("b5_forward_read", "SELECT from_addr AS address, tx_hash, idx, row_number() OVER (PARTITION BY from_addr ORDER BY ts, tx_hash, idx) AS place FROM mv")
def b5f(spark, d):
    """All sends of every address from the earliest."""
    return facts.directional_read(movements(spark, d), "forward").select("address", "tx_hash", "idx", F.col("place").cast("long").alias("place"))


SIDES = "sides AS (SELECT *, to_addr AS address, 'in' AS side, from_addr AS other FROM mv UNION ALL SELECT *, from_addr, 'out', to_addr FROM mv)"


@query("b6_comparable_window", SIDES + " SELECT address, side, tx_hash, dedup_key, row_number() OVER (PARTITION BY address, side ORDER BY ts DESC, tx_hash, idx, dedup_key) AS place FROM sides QUALIFY place <= 8")
def b6(spark, d):
    """The newest rows of both sides of every address."""
    return facts.comparable_window(movements(spark, d), 8).select("address", "side", "tx_hash", "dedup_key", F.col("place").cast("long").alias("place"))


@query("b7_tx_halves", """t AS (SELECT DISTINCT tx_hash FROM halves WHERE to_addr IN (SELECT address FROM lab WHERE category = 'mixer'))
SELECT tx_hash, dedup_key, kind, amount FROM halves WHERE tx_hash IN (SELECT tx_hash FROM t)""")
def b7(spark, d):
    """All halves of transactions that pay a mixer."""
    h = utxo_halves(spark, d)
    mixer = labels(spark, d).where("category = 'mixer'").select("chain", F.col("address").alias("to_addr"))
    return facts.tx_halves(h, h.join(mixer, ["chain", "to_addr"], "left_semi")).select("tx_hash", "dedup_key", "kind", long("amount"))


@query("b8_quality_rules", """r AS (SELECT idx, CASE WHEN idx <= 2 THEN 'utxo_input' WHEN idx = 3 THEN 'utxo_output' ELSE 'token' END AS kind, from_addr, CASE WHEN idx % 2 = 0 THEN NULL ELSE to_addr END AS to_addr FROM mv),
b AS (SELECT concat_ws(',', CASE WHEN kind = 'utxo_input' AND (from_addr IS NULL OR to_addr IS NOT NULL) THEN 'input_ends' END,
  CASE WHEN kind = 'utxo_output' AND (to_addr IS NULL OR from_addr IS NOT NULL) THEN 'output_ends' END,
  CASE WHEN kind = 'token' AND (from_addr IS NULL OR to_addr IS NULL) THEN 'account_ends' END, CASE WHEN from_addr = to_addr THEN 'self_move' END) AS broken FROM r)
SELECT broken, count(*) AS n FROM b GROUP BY broken""")
def b8(spark, d):
    """How many rows break which shape rules, when lines are read as another ledger's halves."""
    r = movements(spark, d).withColumn("kind", F.expr("case when idx <= 2 then 'utxo_input' when idx = 3 then 'utxo_output' else 'token' end")).withColumn("to_addr", F.expr("case when idx % 2 = 0 then null else to_addr end"))
    return facts.broken_rules(r, facts.MOVEMENT_RULES).groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


@query("b9_digest", """SELECT tx_hash, dedup_key, sha256(concat('{"amount":"', amount, '","key":"', dedup_key, '","tx":"', tx_hash, '"}')) AS digest FROM mv""")
def b9(spark, d):
    """Content digest of every movement."""
    return movements(spark, d).select("tx_hash", "dedup_key", facts.digest(F.col("amount_str").alias("amount"), F.col("dedup_key").alias("key"), F.col("tx_hash").alias("tx")).alias("digest"))


@query("b10_identity_conflicts", "SELECT tx_hash, dedup_key, count(*) AS n_rows, count(DISTINCT amount) AS n_amounts, count(DISTINCT provider) AS n_feeds FROM raw GROUP BY ALL HAVING count(DISTINCT amount) > 1")
def b10(spark, d):
    """Keys for which feeds disagree on the amount."""
    return facts.identity_conflicts(raw_movements(spark, d)).drop("chain")


# ---------------------------------------------------------------- counterparties
def _parties(view: str, focus: str, other: str) -> str:
    return f"""ex AS (SELECT chain, {focus} AS focus, {other} AS counterparty, tx_hash, idx, verified, amount, ts FROM {view} WHERE {focus} IS NOT NULL AND {other} IS NOT NULL
  UNION ALL SELECT a.chain, a.focus, b.{other}, b.tx_hash, b.idx, b.verified, b.amount, b.ts
  FROM (SELECT DISTINCT chain, tx_hash, {focus} AS focus FROM {view} WHERE {focus} IS NOT NULL AND {other} IS NULL) a
  JOIN {view} b ON a.chain = b.chain AND a.tx_hash = b.tx_hash AND b.{focus} IS NULL AND b.{other} IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY focus, counterparty ORDER BY amount DESC, ts DESC, tx_hash DESC, idx DESC) AS r FROM ex WHERE focus <> counterparty),
p AS (SELECT focus, counterparty, CAST(sum(CASE WHEN verified THEN amount ELSE 0 END) AS BIGINT) AS value, count(*) AS n_movements, max(CASE WHEN r = 1 THEN tx_hash END) AS largest_tx FROM o GROUP BY focus, counterparty)"""


def _told(p: DataFrame) -> DataFrame:
    return p.select("focus", "counterparty", long("value"), "n_movements", "largest_tx")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Movements written once, for what reads them more than once: whole and by halves, or both ways."""
    return materialize(movements(spark, d), "movements")


@query("c1_funders", _parties("mv", "to_addr", "from_addr") + " SELECT * FROM p")
def c1(spark, d):
    """Who paid every address: verified value, movements, largest movement."""
    return _told(cp.counterparties(stored(spark, d), "backward"))


@query("c1_utxo_recipients", _parties("halves", "from_addr", "to_addr") + " SELECT * FROM p")
def c1u(spark, d):
    """Whom every spending address paid, through the halves of its transactions."""
    return _told(cp.counterparties(utxo_halves(spark, d), "forward"))


@query("counterparties", _parties("mv", "from_addr", "to_addr") + " SELECT *, row_number() OVER (PARTITION BY focus ORDER BY value DESC, counterparty) AS rank, count(*) OVER (PARTITION BY focus) AS n_parties FROM p")
def flagship(spark, d):
    """Ranked recipients of every address; assets that are not evidence-grade cannot steer the order."""
    r = cp.ranked(cp.counterparties(stored(spark, d), "forward"))
    return r.select("focus", "counterparty", long("value"), "n_movements", "largest_tx", F.col("rank").cast("long").alias("rank"), "n_parties")


@query("c2_ranking_guard", _parties("mv", "to_addr", "from_addr") + ", a AS (SELECT focus, counterparty, row_number() OVER (PARTITION BY focus ORDER BY value DESC, counterparty) AS r FROM p), n AS (SELECT focus, counterparty, row_number() OVER (PARTITION BY focus ORDER BY s DESC, counterparty) AS r FROM (SELECT focus, counterparty, sum(amount) AS s FROM ex WHERE focus <> counterparty GROUP BY ALL)) SELECT count(*) AS n_pairs, count(*) FILTER (a.r <> n.r) AS moved FROM a JOIN n USING (focus, counterparty)")
def c2(spark, d):
    """How many ranks differ from what unverified assets would have made of them."""
    both = cp.ranked(cp.counterparties(stored(spark, d), "backward", more=[F.try_sum("amount").alias("all_value")]))
    w = Window.partitionBy("chain", "focus").orderBy(F.desc_nulls_last("all_value"), "counterparty")
    return both.withColumn("naive", F.row_number().over(w)).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("rank") != F.col("naive")).alias("moved"))


@query("c3_supernode_cap", _parties("mv", "from_addr", "to_addr") + ", r AS (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY value DESC, counterparty) AS rank, count(*) OVER (PARTITION BY focus) AS n_parties FROM p) SELECT focus, counterparty, rank, CASE WHEN n_parties > 12 THEN n_parties - 5 ELSE 0 END AS dropped FROM r WHERE n_parties <= 12 OR rank <= 5")
def c3(spark, d):
    """Counterparties that a cap of 12, cut to 5, leaves; thresholds fit the degrees of this ledger."""
    return cp.capped(cp.counterparties(stored(spark, d), "forward"), 12, 5).select("focus", "counterparty", F.col("rank").cast("long").alias("rank"), F.col("dropped").cast("long").alias("dropped"))


@query("c3_cap_findings", """x AS (SELECT DISTINCT from_addr AS focus, tx_hash FROM mv WHERE from_addr <> to_addr), c AS (SELECT from_addr AS focus, count(DISTINCT to_addr) AS n_parties FROM mv WHERE from_addr <> to_addr GROUP BY 1 HAVING count(DISTINCT to_addr) > 12)
SELECT focus, n_parties, n_parties - 5 AS dropped, string_agg(tx_hash, ',' ORDER BY tx_hash) AS refs FROM (SELECT x.*, n_parties, row_number() OVER (PARTITION BY x.focus ORDER BY tx_hash) AS r FROM x JOIN c ON x.focus = c.focus) WHERE r <= 10 GROUP BY focus, n_parties""")
def c3f(spark, d):
    """Findings for capped addresses with up to ten sorted transactions."""
    return cp.cap_findings(stored(spark, d), "forward", 12, 5).select("focus", "n_parties", "dropped", "refs")


# ---------------------------------------------------------------- traces
CASES = """cases AS (SELECT concat('case-', s_nationkey) AS case_id, 'ledger' AS chain, concat('A', s_suppkey % n) AS root FROM supplier, cnt QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    """One case a nation: its richest supplier's address, followed both ways."""
    n = table(spark, d, "orders").count() * 2 // 5
    best = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct(-F.col("s_acctbal"), "s_suppkey")).alias("k"))
    return best.select(F.concat(F.lit("case-"), F.col("s_nationkey").cast("string")).alias("case_id"), F.lit("ledger").alias("chain"), F.concat(F.lit("A"), (F.col("k") % n).cast("string")).alias("root"), F.array(F.lit("find_prev_vasp"), F.lit("find_next_vasp")).alias("objectives"))


@query("c9_objectives", CASES + " SELECT case_id, root, unnest(['backward', 'forward']) AS direction FROM cases")
def c9(spark, d):
    """Directions that each case's objectives ask for."""
    return cp.expand_objectives(cases(spark, d)).select("case_id", "root", "direction")


def closed_by(lab: DataFrame) -> DataFrame:
    """Labelled mixers and services close a branch where they are found."""
    return lab.where("status = 'active' and category in ('mixer', 'vasp')").select("chain", "address", F.col("category").alias("reason"))


def traced(spark: SparkSession, d: str, mv: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all cases, two hops each way, hubs of more than 15 cut to 6; ``mv`` are movements stored already."""
    c = cp.expand_objectives(cases(spark, d)).select("case_id", "chain", "root", "direction")
    return cp.trace(c, stored(spark, d) if mv is None else mv, closed_by(labels(spark, d)), 2, 15, 6)


RANKED = CASES + """,
dirs AS (SELECT *, unnest(['backward', 'forward']) AS direction FROM cases),
stop AS MATERIALIZED (SELECT address, min(category) AS reason FROM lab WHERE status = 'active' AND category IN ('mixer', 'vasp') GROUP BY address),
bt AS MATERIALIZED (SELECT 'backward' AS direction, to_addr AS focus, from_addr AS cp, * FROM mv UNION ALL SELECT 'forward', from_addr, to_addr, * FROM mv),
par AS MATERIALIZED (SELECT direction, focus, cp, CAST(sum(CASE WHEN verified THEN amount ELSE 0 END) AS BIGINT) AS value,
          arg_max(tx_hash, {'a': amount, 't': ts, 'h': tx_hash, 'i': idx}) AS tx_hash FROM bt WHERE focus <> cp GROUP BY ALL),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY direction, focus ORDER BY value DESC, cp) AS rank, count(*) OVER (PARTITION BY direction, focus) AS n FROM par)"""
TRACE = RANKED + """,
n1 AS MATERIALIZED (SELECT d.case_id, d.direction, rk.cp AS address, 1 AS hop, rk.value, d.root AS parent, rk.tx_hash FROM dirs d JOIN rk ON rk.direction = d.direction AND rk.focus = d.root),
o1 AS MATERIALIZED (SELECT n1.* FROM n1 LEFT JOIN stop USING (address) WHERE stop.reason IS NULL),
e2 AS MATERIALIZED (SELECT o1.case_id, o1.direction, o1.address AS parent, o1.value AS pv, rk.cp AS address, rk.value, rk.tx_hash, CASE WHEN rk.n > 15 THEN rk.n - 6 ELSE 0 END AS dropped
       FROM o1 JOIN rk ON rk.direction = o1.direction AND rk.focus = o1.address WHERE rk.n <= 15 OR rk.rank <= 6),
n2 AS MATERIALIZED (SELECT case_id, direction, address, 2 AS hop, value, parent, tx_hash FROM e2
       WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.case_id = e2.case_id AND n1.direction = e2.direction AND n1.address = e2.address)
         AND NOT EXISTS (SELECT 1 FROM dirs WHERE dirs.case_id = e2.case_id AND dirs.root = e2.address)
       QUALIFY row_number() OVER (PARTITION BY case_id, direction, address ORDER BY pv DESC, parent) = 1),
nodes AS MATERIALIZED (SELECT case_id, direction, root AS address, 0 AS hop, NULL::BIGINT AS value, NULL::VARCHAR AS parent, NULL::VARCHAR AS tx_hash FROM dirs UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2),
st AS MATERIALIZED (SELECT nodes.*, CASE WHEN hop > 0 AND reason IS NOT NULL THEN 'closed' WHEN hop = 2 THEN 'depth_horizon' ELSE 'expanded' END AS state FROM nodes LEFT JOIN stop USING (address))"""


@query("c4_trace", TRACE + " SELECT case_id, direction, address, hop, value, parent, tx_hash, state FROM st")
def c4(spark, d):
    """Every address that the cases reach, with its discovering parent and state."""
    nodes, _ = traced(spark, d)
    return nodes.select("case_id", "direction", "address", "hop", long("value"), "parent", "tx_hash", "state")


@query("c4_trace_edges", TRACE + " SELECT case_id, direction, parent AS src, address AS dst, 1 AS hop, value FROM n1 UNION ALL SELECT case_id, direction, parent, address, 2, value FROM e2")
def c4e(spark, d):
    """Every edge that the cases walk, those into known addresses included."""
    _, edges = traced(spark, d)
    return edges.select("case_id", "direction", "src", "dst", "hop", long("value"))


@query("c4_deep_trace")
def c4d(spark, d):
    """Every address reached from every supplier's address, at the operator's own depth and cap."""
    n = table(spark, d, "orders").count() * 2 // 5
    case, root = F.concat(F.lit("case-s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("A"), (F.col("s_suppkey") % n).cast("string"))
    c = table(spark, d, "supplier").select(case.alias("case_id"), F.lit("ledger").alias("chain"), root.alias("root"), F.explode(F.array(F.lit("backward"), F.lit("forward"))).alias("direction"))
    nodes, _ = cp.trace(c, stored(spark, d), closed_by(labels(spark, d)), nodes_only=True)
    return nodes.select("case_id", "direction", "address", "hop", long("value"), "parent", "state")


@query("c6_budgeted_trace", TRACE + """, q AS (SELECT n1.*, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, address, direction) + 2 AS k FROM n1)
SELECT case_id, direction, address, hop, value, k > 20 AS cut FROM q UNION ALL SELECT case_id, direction, address, hop, value, false FROM nodes WHERE hop = 0""")
def c6(spark, d):
    """One hop of all cases under a budget of 20 nodes each, cut in claim order; what is cut stays as frontier."""
    c = cp.expand_objectives(cases(spark, d)).select("case_id", "chain", "root", "direction")
    nodes, _ = cp.trace(c, stored(spark, d), closed_by(labels(spark, d)), 1, 15, 6, max_nodes=20)
    return nodes.select("case_id", "direction", "address", "hop", long("value"), (F.col("state") == "frontier").alias("cut"))


@query("c7_resumed_trace", TRACE + " SELECT case_id, direction, address, hop, value, parent, state FROM st")
def c7(spark, d):
    """All cases stopped after one hop and resumed for another."""
    c = cp.expand_objectives(cases(spark, d)).select("case_id", "chain", "root", "direction")
    mv, stop = stored(spark, d), closed_by(labels(spark, d))
    nodes, edges = cp.trace(c, mv, stop, 1, 15, 6)
    nodes, _ = cp.resume(nodes, edges, mv, stop, max_depth=2, cap_over=15, cap_keep=6)
    return nodes.select("case_id", "direction", "address", "hop", long("value"), "parent", "state")


@query("c7_resumed_budget", TRACE + """, q AS (SELECT n1.*, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, address, direction) + 2 AS k FROM n1)
SELECT case_id, direction, address, hop, value, CASE WHEN k > 14 THEN 'frontier' WHEN reason IS NOT NULL THEN 'closed' ELSE 'depth_horizon' END AS state FROM q LEFT JOIN stop USING (address) UNION ALL SELECT case_id, direction, address, hop, value, 'expanded' FROM nodes WHERE hop = 0""")
def c7b(spark, d):
    """All cases stopped at eight nodes and resumed with fourteen: what was cut is admitted in claim order up to the new budget."""
    c = cp.expand_objectives(cases(spark, d)).select("case_id", "chain", "root", "direction")
    mv, stop = stored(spark, d), closed_by(labels(spark, d))
    nodes, edges = cp.trace(c, mv, stop, 1, 15, 6, max_nodes=8)
    nodes, _ = cp.resume(nodes, edges, mv, stop, max_depth=1, cap_over=15, cap_keep=6, max_nodes=14)
    return nodes.select("case_id", "direction", "address", "hop", long("value"), "state")


@query("c8_paths", TRACE + """ SELECT a.case_id, a.direction, a.address, a.hop AS hops, CASE a.hop WHEN 0 THEN '' WHEN 1 THEN a.tx_hash ELSE concat(b.tx_hash, ',', a.tx_hash) END AS path
FROM nodes a LEFT JOIN n1 b ON a.hop = 2 AND a.case_id = b.case_id AND a.direction = b.direction AND a.parent = b.address""")
def c8(spark, d):
    """Transactions from each root to each reached address."""
    nodes, _ = traced(spark, d)
    return cp.shortest_paths(nodes, 2).select("case_id", "direction", "address", "hops", F.array_join("path", ",").alias("path"))


@query("c10_hop_profile", TRACE + """, h AS (SELECT case_id, direction, hop, count(*) AS n_nodes, count(*) FILTER (state = 'closed') AS n_closed FROM st GROUP BY ALL)
SELECT *, n_nodes / CAST(lag(n_nodes) OVER (PARTITION BY case_id, direction ORDER BY hop) AS DOUBLE) AS growth FROM h""")
def c10(spark, d):
    """Nodes by hop and growth from hop to hop."""
    nodes, _ = traced(spark, d)
    return cp.hop_profile(nodes)


@query("c11_ego_links", SIDES + """, p AS (SELECT address, side, other, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n FROM sides WHERE other <> address GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY address, side ORDER BY amount DESC, other) AS place FROM p QUALIFY place <= 4""")
def c11(spark, d):
    """The four largest links on each side of every address."""
    return answers.ego_links(facts.sides(movements(spark, d)), 4).select("address", "side", "other", long("amount"), "n", F.col("place").cast("long").alias("place"))


@query("c12_tx_graph", """SELECT tx_hash, coalesce(from_addr, to_addr) AS address, CASE WHEN idx <= 2 THEN -1 ELSE 1 END AS level, row_number() OVER (PARTITION BY tx_hash, idx <= 2 ORDER BY idx, dedup_key) AS place, amount FROM halves QUALIFY place <= 3""")
def c12(spark, d):
    """The first three inputs and outputs around every transaction."""
    return answers.tx_graph(utxo_halves(spark, d), 3).select("tx_hash", "address", "level", F.col("place").cast("long").alias("place"), long("amount"))


@query("c13_signed_levels", TRACE + """, l AS (SELECT case_id, address, arg_min(lv, {'h': hop, 'l': lv}) AS level FROM (SELECT case_id, address, hop, CASE WHEN direction = 'backward' THEN -hop ELSE hop END AS lv FROM nodes) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY case_id, level ORDER BY address) AS place FROM l""")
def c13(spark, d):
    """Drawing levels of every case: funders left of the root, recipients right of it."""
    nodes, _ = traced(spark, d)
    return answers.signed_levels(nodes).select("case_id", "address", "level", F.col("place").cast("long").alias("place"))


def _search_sql(levels: int, own: bool, walls: bool) -> str:
    """CTEs of a breadth-first search over both(parent, address, sign, tx_hash), unrolled; f has all that is found."""
    told = ["f0 AS MATERIALIZED (SELECT DISTINCT case_id, root AS address, 0 AS hops, 0 AS level, CAST([] AS VARCHAR[]) AS path FROM cases)"]
    for k in range(1, levels + 1):
        wall = f"AND ({k} = 1 OR NOT EXISTS (SELECT 1 FROM walls w WHERE w.case_id = a.case_id AND w.address = a.address))" if walls else ""
        told.append(f"""g{k} AS MATERIALIZED (SELECT a.case_id, b.address, {k} AS hops, a.level + b.sign AS level, list_append(a.path, b.tx_hash) AS path FROM f{k - 1} a JOIN both_ways b ON a.address = b.parent {'AND a.case_id = b.case_id' if own else ''}
WHERE a.hops = {k - 1} {wall} AND NOT EXISTS (SELECT 1 FROM f{k - 1} o WHERE o.case_id = a.case_id AND o.address = b.address) QUALIFY row_number() OVER (PARTITION BY a.case_id, b.address ORDER BY b.parent, b.sign DESC, b.tx_hash) = 1),
f{k} AS MATERIALIZED (SELECT * FROM f{k - 1} UNION ALL SELECT * FROM g{k})""")
    return ",\n".join(told)


CASE_LINKS = """, ed AS MATERIALIZED (SELECT case_id, direction, parent AS src, address AS dst, tx_hash FROM n1 UNION ALL SELECT case_id, direction, parent, address, tx_hash FROM e2),
li AS (SELECT case_id, CASE direction WHEN 'backward' THEN dst ELSE src END AS payer, CASE direction WHEN 'backward' THEN src ELSE dst END AS payee, tx_hash FROM ed),
both_ways AS MATERIALIZED (SELECT case_id, payer AS parent, payee AS address, 1 AS sign, tx_hash FROM li UNION SELECT case_id, payee, payer, -1, tx_hash FROM li),
walls AS MATERIALIZED (SELECT DISTINCT case_id, st.address FROM st JOIN stop ON st.address = stop.address WHERE state = 'closed' AND stop.reason = 'mixer'), """


def _case_search(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes, edges = traced(spark, d)
    nodes = materialize(nodes, "nodes")
    walls = nodes.where("state = 'closed' and reason = 'mixer'").select("case_id", "address")
    return nodes, paths.linked_search(paths.case_links(edges), cases(spark, d).select("case_id", "root"), walls)


@query("c8_linked_paths", TRACE + CASE_LINKS + _search_sql(3, True, True) + " SELECT case_id, address, hops, array_to_string(path, ',') AS path FROM f3")
def c8l(spark, d):
    """Shortest paths over all edges of a case, walked both ways; a mixer where a branch was closed ends a path and carries none."""
    _, found = _case_search(spark, d)
    return found.select("case_id", "address", F.col("hops").cast("long").alias("hops"), F.array_join("path", ",").alias("path"))


@query("c13_case_levels", TRACE + CASE_LINKS + _search_sql(3, True, True) + ", l AS (SELECT n.case_id, n.address, coalesce(f3.level, 0) AS level FROM (SELECT DISTINCT case_id, address FROM nodes) n LEFT JOIN f3 USING (case_id, address)) SELECT *, row_number() OVER (PARTITION BY case_id, level ORDER BY address) AS place FROM l")
def c13l(spark, d):
    """Drawing levels of every case by the same search: recipients above zero, funders below, turns counted back."""
    nodes, found = _case_search(spark, d)
    return paths.drawing_levels(nodes, found).select("case_id", "address", F.col("level").cast("long").alias("level"), F.col("place").cast("long").alias("place"))


#: Links from a root that the search over the whole ledger goes.
LEDGER_LEVELS = 3


@query("c13_ledger_levels", CASES + """, li AS (SELECT from_addr AS payer, to_addr AS payee, min(tx_hash) AS tx_hash FROM mv WHERE from_addr <> to_addr GROUP BY ALL),
both_ways AS MATERIALIZED (SELECT payer AS parent, payee AS address, 1 AS sign, tx_hash FROM li UNION ALL SELECT payee, payer, -1, tx_hash FROM li), """ + _search_sql(LEDGER_LEVELS, False, False) + f" SELECT case_id, address, hops, level, array_to_string(path, ',') AS path FROM f{LEDGER_LEVELS}")
def c13g(spark, d):
    """Addresses within three links of each case's root over the whole ledger, most of them reached by turning round; hops, level, path."""
    links = movements(spark, d).select(F.col("from_addr").alias("payer"), F.col("to_addr").alias("payee"), "tx_hash")
    found = paths.linked_search(links, cases(spark, d).select("case_id", "root"), max_levels=LEDGER_LEVELS)
    return found.select("case_id", "address", F.col("hops").cast("long").alias("hops"), F.col("level").cast("long").alias("level"), F.array_join("path", ",").alias("path"))


# ---------------------------------------------------------------- knowledge
ENDS = "ends AS (SELECT DISTINCT to_addr AS address FROM mv UNION SELECT from_addr FROM mv)"


def addresses(spark, d) -> DataFrame:
    """All addresses of the ledger."""
    return facts.sides(movements(spark, d)).select("chain", "address").distinct()


@query("d1_attribution", ENDS + """ SELECT address, entity, category, role, confidence, source, row_number() OVER (PARTITION BY address ORDER BY confidence DESC, source, entity, category, role, source_date) AS place
FROM lab JOIN ends USING (address) WHERE status = 'active'""")
def d1(spark, d):
    """Active claims on every address in order."""
    return knowledge.attributed(addresses(spark, d), labels(spark, d)).select("address", "entity", "category", "role", "confidence", "source", F.col("place").cast("long").alias("place"))


@query("d2_precedence", """SELECT address, bool_or(category = 'mixer') AS mixer, bool_or(category = 'vasp') AS vasp, bool_or(category = 'sanctioned') AS sanctioned, bool_or(category = 'infrastructure') AS infrastructure,
CASE WHEN bool_or(category = 'mixer') THEN 'mixer' WHEN bool_or(category = 'vasp') THEN 'endpoint' ELSE 'continue' END AS action FROM lab WHERE status = 'active' GROUP BY address""")
def d2(spark, d):
    """What labels make of each address."""
    return knowledge.precedence(labels(spark, d)).drop("chain")


@query("d3_sanctions_screen", ENDS + " SELECT address FROM ends WHERE address IN (SELECT address FROM lab WHERE status = 'active' AND category = 'sanctioned')")
def d3(spark, d):
    """Addresses of the ledger on a sanctions claim."""
    return knowledge.screened(addresses(spark, d), labels(spark, d)).select("address")


@query("d4_unnamed_endpoints", """hub AS (SELECT to_addr AS address FROM mv GROUP BY 1 HAVING count(DISTINCT from_addr) >= 8) SELECT address FROM hub WHERE address NOT IN (SELECT address FROM lab WHERE status = 'active')""")
def d4(spark, d):
    """Addresses with eight senders and more that no active claim names."""
    hub = movements(spark, d).groupBy("chain", F.col("to_addr").alias("address")).agg(F.count_distinct("from_addr").alias("n")).where("n >= 8")
    return knowledge.unnamed(hub, labels(spark, d)).select("address")


META = "meta AS (SELECT lower(n_name) AS stem, CASE WHEN n_nationkey % 4 > 0 THEN r_name END AS jurisdiction, CASE WHEN n_nationkey % 3 > 0 THEN concat(n_name, ' Ltd') END AS legal_entity FROM nation JOIN region ON n_regionkey = r_regionkey)"


def metadata(spark, d) -> DataFrame:
    """Operator metadata: one row a nation, some without jurisdiction or legal entity."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.initcap("n_name"), F.lit(" 1")).alias("entity"), F.when(F.col("n_nationkey") % 4 > 0, F.col("r_name")).alias("jurisdiction"), F.when(F.col("n_nationkey") % 3 > 0, F.concat("n_name", F.lit(" Ltd"))).alias("legal_entity"), F.when(F.col("n_nationkey") % 2 == 0, "checked").alias("notes"))


@query("d5_metadata", META + r""", l AS (SELECT DISTINCT address, entity, regexp_replace(lower(entity), '[\s\-_]+\d+$', '') AS s1 FROM lab WHERE status = 'active')
SELECT address, entity, jurisdiction, legal_entity, jurisdiction IS NOT NULL AND legal_entity IS NOT NULL AS serviceable FROM l LEFT JOIN meta ON s1 = stem""")
def d5(spark, d):
    """Active claims with the metadata of their operator."""
    named = labels(spark, d).where("status = 'active'").select("address", "entity").distinct()
    return knowledge.with_metadata(named, metadata(spark, d)).select("address", "entity", "jurisdiction", "legal_entity", "serviceable")


@query("d6_pending_leads", ENDS + """, p AS (SELECT address, count(*) AS n_leads, string_agg(DISTINCT entity, '|' ORDER BY entity) AS leads FROM lab WHERE status = 'pending' GROUP BY 1)
SELECT address, coalesce(n_leads, 0) AS n_leads, leads FROM ends LEFT JOIN p USING (address)""")
def d6(spark, d):
    """Pending claims beside every address."""
    return knowledge.pending_leads(addresses(spark, d), labels(spark, d)).select("address", "n_leads", "leads")


@query("d7_case_probe", SIDES + """, k AS (SELECT DISTINCT address AS other, category FROM lab WHERE status = 'active' AND category IN ('mixer', 'vasp')),
t AS (SELECT DISTINCT address, other FROM sides WHERE other <> address), b AS (SELECT address, count(*) FILTER (category = 'mixer') AS mixers, count(*) FILTER (category = 'vasp') AS vasps FROM t JOIN k USING (other) GROUP BY 1),
x AS (SELECT address, count(DISTINCT tx_hash) AS n_txs FROM sides WHERE other <> address GROUP BY 1)
SELECT address, mixers, vasps, n_txs FROM b JOIN x USING (address) WHERE mixers > 0 AND vasps > 0 ORDER BY mixers DESC, vasps DESC, address LIMIT 10""")
def d7(spark, d):
    """The ten addresses that touch most mixers and services: a top-k report."""
    return knowledge.case_probe(facts.sides(movements(spark, d)), labels(spark, d)).select("address", "mixers", "vasps", "n_txs")


PRICES = "prices AS (SELECT ['A', 'N', 'R'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS asset, o_orderdate AS day, max(o_totalprice) AS price FROM orders GROUP BY ALL)"


@query("d8_usd_value", PRICES + " SELECT tx_hash, dedup_key, coalesce(price, 0.0) AS price, CAST(amount AS DOUBLE) * coalesce(price, 0.0) AS usd FROM mv ASOF LEFT JOIN prices ON mv.asset = prices.asset AND mv.ts >= prices.day")
def d8(spark, d):
    """Movements at the latest price of their asset."""
    o = table(spark, d, "orders")
    prices = o.groupBy(F.get(F.array(*map(F.lit, "ANR")), (F.col("o_orderkey") % 3).cast("int")).alias("asset"), F.col("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    return knowledge.valued(movements(spark, d), prices).select("tx_hash", "dedup_key", "price", "usd")


