"""Registered queries of detectors, mixer exits, clusters, label lifecycle and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, clusters, detectors, facts, knowledge, lifecycle, mixers
from ..runtime import SMALL_ROWS, materialize, sized_broadcast
from .queries_facts import CASES, SIDES, TRACE, Q, S, cases, long, query, stored, traced
from .views import labels, movements, table, utxo_halves

__all__ = ["Q", "S"]
WINDOW = SIDES + ", w AS (SELECT * FROM sides WHERE verified QUALIFY row_number() OVER (PARTITION BY address, side ORDER BY ts DESC, tx_hash, idx, dedup_key) <= 500)"
DAY = 86_400


def window(spark, d) -> DataFrame:
    """What detectors read: verified movements, the newest 500 a side."""
    return facts.comparable_window(movements(spark, d).where("verified"))


@query("g5_fan_in", WINDOW + """, r AS (SELECT address, tx_hash, row_number() OVER (PARTITION BY address ORDER BY tx_hash) AS k FROM (SELECT DISTINCT address, tx_hash FROM w WHERE side = 'in')),
f AS (SELECT address, string_agg(tx_hash, ',' ORDER BY tx_hash) AS refs FROM r WHERE k <= 8 GROUP BY 1)
SELECT address, senders, refs, round_even(least(senders / 32, 1.0), 3) AS strength, round_even(least(0.5 + 0.25 * least(senders / 32, 1.0), 0.9), 3) AS confidence
FROM (SELECT address, count(DISTINCT other) AS senders FROM w WHERE side = 'in' GROUP BY 1 HAVING count(DISTINCT other) >= 8) JOIN f USING (address)""")
def g5(spark, d):
    """Addresses with eight senders and more."""
    return detectors.fan_in(window(spark, d)).select("address", "senders", "refs", "strength", "confidence")


@query("g6_distribution", WINDOW + """, a AS (SELECT address, count(DISTINCT other) AS recipients FROM w WHERE side = 'out' GROUP BY 1),
e AS (SELECT address, max(n) AS equal FROM (SELECT address, asset, amount, count(*) AS n FROM w WHERE side = 'out' AND amount > 0 GROUP BY ALL) GROUP BY 1),
x AS (SELECT address, recipients, coalesce(equal, 0) AS equal FROM a LEFT JOIN e USING (address))
SELECT *, CASE WHEN recipients >= 6 AND equal >= 2 AND equal >= 0.8 * recipients THEN 'batch-distribution@1' WHEN recipients >= 6 THEN 'fan-out@1' ELSE 'equal-split@1' END AS heuristic FROM x WHERE recipients >= 6 OR equal >= 2""")
def g6(spark, d):
    """How addresses pay out, with thresholds that fit the degrees of this ledger."""
    return detectors.distribution(window(spark, d), 6, 2).select("address", "recipients", "equal", "heuristic")


@query("g7_service_endpoint", WINDOW + """, x AS (SELECT address, count(DISTINCT other) FILTER (side = 'in') AS senders, count(DISTINCT other) FILTER (side = 'out') AS recipients FROM w GROUP BY 1)
SELECT address, senders, recipients, round_even(least(0.55 + 0.2 * least((senders + recipients) / 400, 1.0), 0.75), 3) AS confidence FROM x
WHERE senders >= 7 AND recipients >= 7 AND senders + recipients >= 16 AND address NOT IN (SELECT address FROM lab WHERE status = 'active' AND category = 'infrastructure')""")
def g7(spark, d):
    """Service-like hubs that no infrastructure label explains, thresholds fitted to this ledger."""
    infra = labels(spark, d).where("status = 'active' and category = 'infrastructure'").select("chain", "address").distinct()
    return detectors.service_endpoint(window(spark, d), infra, 7, 7, 16).drop("chain")


@query("g3_peel_chain", WINDOW + """, j AS (SELECT i.address, i.asset, i.tx_hash, i.idx, i.amount, i.ts, o.amount AS sent FROM w i JOIN w o ON i.side = 'in' AND o.side = 'out' AND i.address = o.address AND i.asset = o.asset AND i.amount > 0 AND o.amount > 0 AND o.ts >= i.ts AND o.ts <= i.ts + INTERVAL 90 DAY),
p AS (SELECT address, asset, tx_hash, idx, amount, ts, count(*) AS sends, max(sent) AS most, min(sent) AS least FROM j GROUP BY ALL)
SELECT address, asset, tx_hash, sends, round_even(most / amount, 3) AS ratio FROM p WHERE sends >= 2 AND most / amount BETWEEN 0.7 AND 1.0 AND least > 0 AND least / amount <= 0.3
QUALIFY row_number() OVER (PARTITION BY address ORDER BY ts, tx_hash, idx, asset) = 1""")
def g3(spark, d):
    """Receipts peeled within 90 days (daily grain needs a wide window)."""
    return detectors.peel_chain(window(spark, d), 90 * DAY).select("address", "asset", F.col("in_tx_hash").alias("tx_hash"), "sends", "ratio")


@query("g1_onward_pairs", WINDOW + """ SELECT i.address, i.asset, i.tx_hash AS in_tx, i.idx AS in_idx, o.tx_hash AS out_tx, o.idx AS out_idx FROM w i JOIN w o ON i.side = 'in' AND o.side = 'out' AND i.address = o.address AND i.asset = o.asset AND i.amount > 0 AND o.amount > 0 AND o.ts >= i.ts AND o.ts <= i.ts + INTERVAL 30 DAY""")
def g1p(spark, d):
    """Receipts with the sends of the next 30 days: the range join below the matchers."""
    p = detectors.onward(window(spark, d), 30 * DAY)
    return p.select("address", "asset", F.col("in_tx_hash").alias("in_tx"), "in_idx", F.col("out_tx_hash").alias("out_tx"), "out_idx")


@query("g1_sweep_pairs")
def g1(spark, d):
    """Receipts passed on nearly whole within 30 days, greedily matched."""
    return detectors.sweep_pairs(window(spark, d), 30 * DAY)


@query("g2_sweep_findings")
def g2(spark, d):
    """A finding for each sweeping address."""
    return detectors.sweep_findings(detectors.sweep_pairs(window(spark, d), 30 * DAY), 30 * DAY)


@query("g4_rapid_hops")
def g4(spark, d):
    """Relays among users of the event stream: purchases and signups follow one another."""
    e = table(spark, d, "events")
    w = e.select(F.lit("ledger").alias("chain"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("address"), F.lit("E").alias("asset"), F.when(F.col("event_type").isin("signup", "view"), "in").otherwise("out").alias("side"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("tx_hash"), F.lit(0).alias("idx"), (F.col("value") * 100).cast("decimal(38,0)").alias("amount"), "ts")
    return detectors.rapid_hops(w, 6 * 3600)


@query("g9_reached_once", TRACE + " SELECT DISTINCT address FROM nodes WHERE hop > 0")
def g9(spark, d):
    """Addresses that detectors run on: each once, whichever way it was reached."""
    nodes, _ = traced(spark, d)
    return nodes.where("hop > 0").select("address").distinct()


@query("g10_forgery_report", """a AS (SELECT asset, amount, count(*) AS n, count(*) FILTER (NOT verified) AS u FROM mv GROUP BY ALL)
SELECT asset, CAST(sum(n) AS BIGINT) AS n_movements, CAST(sum(u) AS BIGINT) AS n_unverified, count(*) FILTER (n >= 2) AS n_sprayed_amounts, max(n) AS largest_spray FROM a GROUP BY 1""")
def g10(spark, d):
    """Unverified shares and identical-amount sprays by asset."""
    return detectors.forgery_report(movements(spark, d), 2).drop("chain")


# ---------------------------------------------------------------- mixers
MIX = """m AS (SELECT DISTINCT address AS mixer FROM lab WHERE category = 'mixer' AND status = 'active'),
mx AS (SELECT m.mixer, asset, from_addr AS party, tx_hash, 'deposit' AS side, amount, ts, gas_price FROM mv JOIN m ON to_addr = m.mixer UNION ALL SELECT m.mixer, asset, to_addr, tx_hash, 'withdrawal', amount, ts, gas_price FROM mv JOIN m ON from_addr = m.mixer),
ev AS (SELECT mixer, asset, party, tx_hash, side, amount, ts, gas_price FROM mx WHERE party <> mixer AND party NOT IN (SELECT mixer FROM m) QUALIFY row_number() OVER (PARTITION BY mixer, asset, party, tx_hash, side ORDER BY amount DESC, ts DESC, gas_price DESC NULLS LAST) = 1),
an AS (SELECT mixer, party, asset, amount, tx_hash, ts, gas_price, (SELECT count(DISTINCT tx_hash) - 1 FROM ev y WHERE y.mixer = ev.mixer AND y.party = ev.party AND y.side = 'deposit') AS unanchored
  FROM ev WHERE side = 'deposit' QUALIFY row_number() OVER (PARTITION BY mixer, party ORDER BY amount DESC, tx_hash DESC, asset DESC, ts DESC, gas_price DESC NULLS LAST) = 1),
far AS (SELECT mixer, asset, party AS far, tx_hash AS far_tx, amount AS far_amount, ts AS far_ts, gas_price AS far_gas FROM ev WHERE side = 'withdrawal'),
jn AS (SELECT an.*, far, far_tx, far_amount, far_ts FROM an JOIN far USING (mixer, asset) WHERE far_ts > ts),
ties AS (SELECT DISTINCT least(from_addr, to_addr) AS lo, greatest(from_addr, to_addr) AS hi FROM mv WHERE from_addr <> to_addr),
pr AS (SELECT mixer, gas_price FROM ev WHERE gas_price > 0 GROUP BY ALL HAVING count(*) FILTER (side = 'withdrawal') = 1 AND count(*) FILTER (side = 'deposit') = 1),
fp AS (SELECT mixer, party, side, string_agg(concat(asset, '=', n), ',' ORDER BY concat(asset, '=', n)) AS print FROM (SELECT mixer, party, side, asset, count(*) AS n FROM ev GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2),
one AS (SELECT mixer, party, asset, tx_hash, unanchored, far, far_tx, 1 AS rung FROM jn WHERE far = party),
two AS (SELECT mixer, party, asset, tx_hash, unanchored, far, far_tx, 2 AS rung FROM jn WHERE far <> party AND EXISTS (SELECT 1 FROM ties WHERE lo = least(far, party) AND hi = greatest(far, party))),
thr AS (SELECT an.mixer, an.party, an.asset, an.tx_hash, an.unanchored, far, far_tx, 3 AS rung FROM an JOIN pr USING (mixer, gas_price) JOIN far ON far.mixer = an.mixer AND far.asset = an.asset AND far_gas = an.gas_price WHERE far_ts > an.ts),
uniq AS (SELECT mixer, print, party AS far FROM fp WHERE side = 'withdrawal' QUALIFY count(*) OVER (PARTITION BY mixer, print) = 1),
fou AS (SELECT jn.mixer, jn.party, jn.asset, jn.tx_hash, jn.unanchored, jn.far, far_tx, 4 AS rung FROM jn JOIN fp ON fp.mixer = jn.mixer AND fp.party = jn.party AND fp.side = 'deposit' JOIN uniq ON uniq.mixer = jn.mixer AND uniq.print = fp.print AND uniq.far = jn.far),
early AS (SELECT *, NULL::BIGINT AS crowd FROM (FROM one UNION ALL FROM two UNION ALL FROM thr UNION ALL FROM fou)),
near AS (SELECT mixer, party, asset, tx_hash, unanchored, far, far_tx, 5 AS rung, count(*) OVER (PARTITION BY mixer, party) AS crowd, row_number() OVER (PARTITION BY mixer, party ORDER BY far_amount DESC, far_ts - ts, far_tx, far) AS place
  FROM jn WHERE far_ts <= ts + INTERVAL 90 DAY AND NOT EXISTS (SELECT 1 FROM early e WHERE e.mixer = jn.mixer AND e.party = jn.party)),
al AS (SELECT * FROM early UNION ALL SELECT mixer, party, asset, tx_hash, unanchored, far, far_tx, rung, crowd FROM near WHERE place <= 20),
cd AS (SELECT mixer, party, asset, tx_hash, unanchored, rung, far, min(far_tx) AS far_tx, max(crowd) AS crowd FROM (SELECT * FROM al QUALIFY rung = min(rung) OVER (PARTITION BY mixer, party)) GROUP BY ALL),
ex AS (SELECT *, greatest(round_even(CASE rung WHEN 5 THEN least(0.5, 1 / crowd) ELSE [0.8, 0.7, 0.65, 0.6][rung] / count(*) OVER (PARTITION BY mixer, party) END, 3), 0.001) AS confidence FROM cd)"""


def mixer_events(spark, d, mv=None):
    """Activity of labelled mixers, stored: the ladder reads it many times; ``mv`` are movements stored already."""
    mv = stored(spark, d) if mv is None else mv
    mix = labels(spark, d).where("category = 'mixer' and status = 'active'").select("chain", "address").distinct()
    return mv, materialize(mixers.activity(mv, mix), "events")


@query("h1_mixer_activity", MIX + " SELECT mixer, asset, party, tx_hash, side, amount, gas_price FROM ev")
def h1(spark, d):
    """Deposits into and withdrawals from every mixer."""
    return mixer_events(spark, d)[1].select("mixer", "asset", "party", "tx_hash", "side", long("amount"), long("gas_price"))


@query("h2_anchors", MIX + " SELECT mixer, party, asset, amount, tx_hash, unanchored FROM an")
def h2(spark, d):
    """The largest deposit of each party at each mixer, and how many others it made."""
    return mixers.anchors(mixer_events(spark, d)[1]).select("mixer", "party", "asset", long("amount"), "tx_hash", "unanchored")


@query("h4_crowd", MIX + " SELECT mixer, party, count(*) AS crowd FROM jn WHERE far_ts <= ts + INTERVAL 90 DAY GROUP BY ALL")
def h4(spark, d):
    """Withdrawals of the pool in the 90 days after each anchor."""
    ev = mixer_events(spark, d)[1]
    return mixers.crowd(mixers.anchors(ev), ev, "forward", 90).groupBy("mixer", "party").agg(F.count("*").alias("crowd"))


def exit_candidates(spark, d, mv=None):
    """Candidates of all anchors, 90 days of crowd."""
    mv, ev = mixer_events(spark, d, mv)
    return mixers.exits(mv, ev, mixers.anchors(ev), "forward", 90)


@query("h10_exit_ladder", MIX + " SELECT mixer, party, tx_hash, unanchored, rung, far, far_tx, crowd, confidence FROM ex")
def h10(spark, d):
    """The first rung that links each anchor to withdrawals, with shared confidence."""
    return exit_candidates(spark, d).select("mixer", "party", "tx_hash", "unanchored", "rung", "far", "far_tx", "crowd", "confidence")


@query("h5_rungs", MIX + " SELECT rung, count(*) AS n, count(DISTINCT (mixer, party)) AS anchors FROM ex GROUP BY rung")
def h5(spark, d):
    """How many anchors and candidates each rung answers."""
    c = exit_candidates(spark, d)
    return c.groupBy("rung").agg(F.count("*").alias("n"), F.count_distinct("mixer", "party").alias("anchors"))


@query("h11_enqueue", CASES + ", " + MIX + """, q AS (SELECT ex.*, row_number() OVER (PARTITION BY mixer, party ORDER BY confidence DESC, far) AS p FROM ex)
SELECT mixer, party, far, CASE WHEN far IN (SELECT root FROM cases) THEN 'root' WHEN far IN (SELECT address FROM lab WHERE status = 'active') THEN 'known' WHEN p > 20 THEN 'over_cap' ELSE 'queued' END AS fate FROM q""")
def h11(spark, d):
    """What becomes of candidates: followed, or dropped with a reason; labelled addresses stand for the traced ones."""
    known = labels(spark, d).where("status = 'active'").select("chain", "address")
    return mixers.enqueue(exit_candidates(spark, d), known, cases(spark, d)).select("mixer", "party", "far", "fate")


# ---------------------------------------------------------------- clusters
SPEND = """i AS (SELECT tx_hash, count(DISTINCT from_addr) AS inputs, min(from_addr) AS first_input FROM halves WHERE kind = 'utxo_input' GROUP BY 1),
o AS (SELECT tx_hash, CAST(sum(n) AS BIGINT) AS outputs, max(n) AS equal_outputs FROM (SELECT tx_hash, amount // 1000000 AS b, count(*) AS n FROM halves WHERE kind = 'utxo_output' GROUP BY ALL) GROUP BY 1),
sp AS (SELECT i.*, coalesce(outputs, 0) AS outputs, coalesce(equal_outputs, 0) AS equal_outputs FROM i LEFT JOIN o USING (tx_hash)),
tm AS (SELECT DISTINCT tx_hash FROM halves WHERE coalesce(from_addr, to_addr) IN (SELECT address FROM lab WHERE category = 'mixer' AND status = 'active')),
jd AS (SELECT sp.*, CASE WHEN inputs < 2 THEN 'single' WHEN tx_hash IN (SELECT tx_hash FROM tm) THEN 'mixer' WHEN inputs >= 2 AND equal_outputs >= 2 THEN 'coinjoin' ELSE 'joined' END AS verdict FROM sp)"""


def _halves(spark, d):
    """Halves whose output amounts are whole million units, so that equal outputs occur."""
    h = utxo_halves(spark, d)
    return h.withColumn("amount", F.when(F.col("kind") == "utxo_output", F.floor(F.col("amount") / 1_000_000).cast("decimal(38,0)")).otherwise(F.col("amount")))


def _mixer_addresses(spark, d):
    return labels(spark, d).where("category = 'mixer' and status = 'active'").select("chain", "address")


@query("i1_spending", SPEND + " SELECT tx_hash, inputs, first_input, outputs, equal_outputs FROM sp")
def i1(spark, d):
    """Inputs and outputs of every spending transaction."""
    return clusters.spending(_halves(spark, d)).drop("chain")


@query("i2_verdicts", SPEND + " SELECT tx_hash, verdict FROM jd")
def i2(spark, d):
    """Whether a transaction may join its inputs; shapes fitted to two inputs at most."""
    h = _halves(spark, d)
    return clusters.judged(clusters.spending(h), h, _mixer_addresses(spark, d), 2, 2).select("tx_hash", "verdict")


def _clusters(spark, d):
    h = materialize(_halves(spark, d), "halves")
    return materialize(clusters.cospend_clusters(h, _mixer_addresses(spark, d)), "clusters"), h


@query("i3_cospend_clusters")
def i3(spark, d):
    """Addresses that spend together."""
    return _clusters(spark, d)[0]


@query("i4_label_proposals")
def i4(spark, d):
    """Names that clusters lend to their members, and clusters refused for two names."""
    return clusters.proposals(_clusters(spark, d)[0], labels(spark, d))


@query("i5_coverage_gain")
def i5(spark, d):
    """What clustering adds."""
    c = _clusters(spark, d)[0]
    return clusters.coverage(c, clusters.proposals(c, labels(spark, d)))


# ---------------------------------------------------------------- lifecycle
#: One claim a key: what the store holds, by a total order.
STORE = """st0 AS (SELECT chain, address, source, status, entity, category, role, confidence, method, source_date FROM lab QUALIFY row_number() OVER (PARTITION BY chain, address, source ORDER BY status, entity, category, role, confidence, method, source_date) = 1)"""
STEM = r"regexp_replace(lower(entity), '[\s\-_]+\d+$', '')"


def store(spark, d) -> DataFrame:
    """Stored claims: one a (chain, address, source)."""
    return facts.first_write(labels(spark, d), ["status", "entity", "category", "role", "confidence", "method", "source_date"], ["chain", "address", "source"])


ARRIVE = STORE + """, nw AS (SELECT chain, address, source, entity, category, role, CASE WHEN source LIKE 'S%' THEN least(confidence + 0.05, 0.99) ELSE confidence END AS confidence, method, source_date FROM st0 WHERE source <> 'S1'),
od AS (SELECT * FROM st0 WHERE source <> 'S2'),
up AS (SELECT coalesce(od.chain, nw.chain) AS chain, coalesce(od.address, nw.address) AS address, coalesce(od.source, nw.source) AS source, od.status, coalesce(nw.entity, od.entity) AS entity, coalesce(nw.method, od.method) AS method,
  coalesce(nw.confidence, od.confidence) AS confidence, CASE WHEN od.source IS NULL THEN 'added' WHEN nw.source IS NULL THEN 'kept' WHEN od.confidence = nw.confidence THEN 'unchanged' ELSE 'updated' END AS outcome,
  coalesce(nw.source_date, od.source_date) AS source_date FROM od FULL JOIN nw ON od.chain = nw.chain AND od.address = nw.address AND od.source = nw.source)"""


def arrived(spark, d) -> DataFrame:
    """A store without source S2 meets a batch without S1 in which S-claims gained confidence."""
    s = store(spark, d)
    batch = s.where("source <> 'S1'").withColumn("confidence", F.when(F.col("source").startswith("S"), F.least(F.col("confidence") + 0.05, F.lit(0.99))).otherwise(F.col("confidence")))
    return lifecycle.upsert(s.where("source <> 'S2'"), batch)


@query("f1_claim_upsert", ARRIVE + " SELECT address, source, outcome, confidence FROM up")
def f1(spark, d):
    """Outcome of every claim in an upsert."""
    return arrived(spark, d).select("address", "source", "outcome", "confidence")


@query("f2_entity_stem", f"SELECT DISTINCT entity, {STEM} AS stem FROM lab")
def f2(spark, d):
    """Stems of all entities."""
    return labels(spark, d).select("entity").distinct().withColumn("stem", knowledge.entity_stem(F.col("entity")))


@query("f3_arrival", STORE + " SELECT method, count(*) AS n, CASE WHEN method IN ('official', 'proof') THEN 'active' ELSE 'pending' END AS status FROM st0 GROUP BY method")
def f3(spark, d):
    """Status on arrival by method."""
    return store(spark, d).withColumn("s", lifecycle.arrival_status(F.col("method"))).groupBy("method").agg(F.count("*").alias("n"), F.max("s").alias("status"))


CORR = STORE + f""", sm AS (SELECT *, {STEM} AS stem FROM st0), co AS (SELECT a.address, a.source, a.status, a.method, b.source AS by_, b.confidence AS bc FROM sm a JOIN sm b ON a.chain = b.chain AND a.address = b.address AND a.category = b.category AND a.stem = b.stem AND a.source <> b.source
WHERE b.status = 'active' AND b.method IN ('official', 'proof')), bs AS (SELECT address, source, by_ AS corroborated_by FROM co QUALIFY row_number() OVER (PARTITION BY address, source ORDER BY bc DESC, by_) = 1)"""


def claims_for_support(spark, d) -> DataFrame:
    """Claims as stored; customers and suppliers of one address support one another."""
    return store(spark, d)


@query("f4_corroborations", CORR + " SELECT address, source, by_ AS by_source FROM co")
def f4(spark, d):
    """Claims with the active trusted claims that support them."""
    return lifecycle.corroborations(claims_for_support(spark, d)).select("address", "source", F.col("by").alias("by_source"))


@query("f5_reconcile", CORR + """ SELECT st0.address, st0.source, corroborated_by, CASE WHEN status = 'active' AND method NOT IN ('official', 'proof') AND corroborated_by IS NULL THEN 'pending' WHEN status = 'pending' AND corroborated_by IS NOT NULL THEN 'active' ELSE status END AS status
FROM st0 LEFT JOIN bs ON st0.address = bs.address AND st0.source = bs.source""")
def f5(spark, d):
    """Statuses after a cycle of demotion and promotion."""
    return lifecycle.reconcile(claims_for_support(spark, d))[0].select("address", "source", "corroborated_by", "status")


@query("f5_events", CORR + """ SELECT st0.address, st0.source, CASE WHEN status = 'active' THEN 'demoted' ELSE 'promoted' END AS kind FROM st0 LEFT JOIN bs ON st0.address = bs.address AND st0.source = bs.source
WHERE (status = 'active' AND method NOT IN ('official', 'proof') AND corroborated_by IS NULL) OR (status = 'pending' AND corroborated_by IS NOT NULL)""")
def f5e(spark, d):
    """Events of that cycle."""
    return lifecycle.reconcile(claims_for_support(spark, d))[1].select("address", "source", "kind")


@query("f6_resettle", ARRIVE + """ SELECT address, source, CASE WHEN status = 'retired' THEN 'retired' WHEN outcome = 'added' THEN CASE WHEN method IN ('official', 'proof') THEN 'active' ELSE 'pending' END
WHEN outcome = 'updated' AND status = 'active' AND method NOT IN ('official', 'proof') THEN 'pending' WHEN outcome = 'updated' AND status = 'pending' AND method IN ('official', 'proof') THEN 'active' ELSE status END AS status FROM up""")
def f6(spark, d):
    """Status of every claim after an upsert."""
    return lifecycle.settled(arrived(spark, d)).select("address", "source", "status")


@query("f7_retire", STORE + " SELECT address, source, CASE WHEN source = 'C3' THEN 'retired' ELSE status END AS status FROM st0")
def f7(spark, d):
    """Statuses after source C3 is retired."""
    s = store(spark, d)
    return lifecycle.retire(s, s.where("source = 'C3'"))[0].select("address", "source", "status")


@query("f8_event_page", raw="SELECT event_id AS id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def f8(spark, d):
    """A page of fifty log events past a cursor."""
    return lifecycle.event_page(table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"), 100, 50)


@query("f9_snapshot_moved", raw="SELECT max(event_id) AS newest, max(event_id) > 500 AS moved FROM events")
def f9(spark, d):
    """Whether a label snapshot taken at event 500 has to be read again."""
    return lifecycle.snapshot_moved(table(spark, d, "events").select(F.col("event_id").alias("id")), 500)


@query("f10_cycle_report", ARRIVE + """, sc AS (SELECT DISTINCT source FROM st0), x AS (SELECT source, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, max(source_date) AS published_at FROM up WHERE outcome <> 'kept' GROUP BY 1)
SELECT sc.source, coalesce(added, 0) AS added, coalesce(updated, 0) AS updated, coalesce(unchanged, 0) AS unchanged, CAST(published_at AS VARCHAR) AS published_at, published_at IS NULL AS not_supplied, coalesce(DATE '2024-06-01' - published_at > 100, false) AS stale FROM sc LEFT JOIN x USING (source)""")
def f10(spark, d):
    """What each expected source brought, and what is stale."""
    specs = store(spark, d).select("source").distinct().withColumn("max_age_days", F.lit(100))
    return lifecycle.cycle_report(arrived(spark, d), specs, "2024-06-01").select("source", "added", "updated", "unchanged", F.col("published_at").cast("string").alias("published_at"), "not_supplied", "stale")


@query("f11_sync_status", "SELECT chain, count(*) AS active_labels, (SELECT CASE WHEN max(ts) < TIMESTAMP '2024-03-01' - INTERVAL 1 HOUR THEN 'stalled' ELSE 'syncing' END FROM events) AS state FROM lab WHERE status = 'active' GROUP BY chain")
def f11(spark, d):
    """Active labels and the state of the newest run; the event log stands for runs that never ended."""
    runs = table(spark, d, "events").select(F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    return lifecycle.sync_status(runs, labels(spark, d), "2024-03-01 00:00:00")


@query("e12_collisions", "SELECT chain, lower(address) AS address, 'all' AS source, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) > 1")
def e12(spark, d):
    """Keys that several claims share, were all sources one."""
    return lifecycle.collisions(labels(spark, d).withColumn("source", F.lit("all")))


# ---------------------------------------------------------------- answers
FIND = TRACE + """, ac AS (SELECT address, confidence, entity FROM lab WHERE status = 'active' AND category = 'vasp' QUALIFY row_number() OVER (PARTITION BY address ORDER BY confidence DESC, entity DESC, source DESC) = 1),
hb AS (SELECT to_addr AS address, count(DISTINCT from_addr) AS k FROM mv GROUP BY 1 HAVING count(DISTINCT from_addr) >= 12),
fd AS (SELECT case_id, direction, address, hop, true AS named, entity, confidence FROM nodes JOIN ac USING (address) WHERE hop > 0 UNION ALL
       SELECT case_id, direction, address, hop, false, NULL, k / 100 FROM nodes JOIN hb USING (address) WHERE hop > 0 AND address NOT IN (SELECT address FROM ac)),
ne AS (SELECT case_id, direction, address AS nearest, hop AS nearest_hop, named AS nearest_named FROM fd QUALIFY row_number() OVER (PARTITION BY case_id, direction ORDER BY hop, named, confidence DESC, address) = 1),
nn AS (SELECT case_id, direction, address AS named_address, entity AS named_entity, hop AS named_hop FROM fd WHERE named QUALIFY row_number() OVER (PARTITION BY case_id, direction ORDER BY hop, confidence DESC, address) = 1),
aw AS (SELECT ne.*, named_address, named_entity, named_hop FROM ne LEFT JOIN nn USING (case_id, direction))"""


def found(spark, d, mv=None):
    """Nodes and endpoint findings of all cases; addresses with twelve senders stand for service-like hubs."""
    mv = stored(spark, d) if mv is None else mv
    nodes = materialize(traced(spark, d, mv)[0], "nodes")
    # only what the cases reached is asked for its senders
    reached = nodes.select("chain", F.col("address").alias("to_addr")).distinct()
    paid = mv.join(sized_broadcast(reached, nodes.count(), SMALL_ROWS), ["chain", "to_addr"], "left_semi")
    hub = paid.groupBy("chain", F.col("to_addr").alias("address")).agg(F.count_distinct("from_addr").alias("k")).where("k >= 12").select("chain", "address", (F.col("k") / 100).alias("confidence"))
    return nodes, answers.endpoint_findings(nodes, labels(spark, d), hub)


@query("j1_endpoint_findings", FIND + " SELECT case_id, direction, address, hop, named, entity, confidence FROM fd")
def j1(spark, d):
    """Endpoints of all cases with their hop."""
    return found(spark, d)[1].select("case_id", "direction", "address", "hop", "named", "entity", "confidence")


@query("j2_answers", FIND + " SELECT * FROM aw")
def j2(spark, d):
    """Nearest and nearest named endpoint of every case and direction."""
    return answers.direction_answers(found(spark, d)[1])


STAMP = FIND + ", " + MIX + ", sf AS (SELECT fd.*, address IN (SELECT far FROM ex) AS speculative FROM fd)"


def stamped(spark, d):
    """Nodes, and findings with those past a crossing marked."""
    mv = stored(spark, d)
    nodes, f = found(spark, d, mv)
    candidates = exit_candidates(spark, d, mv).withColumn("speculative_basis", F.concat_ws(" ", F.col("rung").cast("string"), F.col("mixer")))
    return nodes, materialize(answers.speculative_stamp(f, candidates), "stamped")


@query("h12_speculative_stamp", STAMP + " SELECT case_id, direction, address, hop, speculative FROM sf")
def h12(spark, d):
    """Findings of all cases, those past a mixer crossing marked."""
    return stamped(spark, d)[1].select("case_id", "direction", "address", "hop", "speculative")


@query("j4_best_effort", STAMP + """, t AS (SELECT case_id, direction, address AS nearest FROM sf WHERE NOT speculative QUALIFY row_number() OVER (PARTITION BY case_id, direction ORDER BY hop, named, confidence DESC, address) = 1),
g AS (SELECT case_id, direction, address AS lead FROM sf WHERE speculative QUALIFY row_number() OVER (PARTITION BY case_id, direction ORDER BY hop, named DESC, confidence DESC, address) = 1)
SELECT coalesce(t.case_id, g.case_id) AS case_id, coalesce(t.direction, g.direction) AS direction, nearest, CASE WHEN nearest IS NULL THEN lead END AS lead FROM t FULL JOIN g ON t.case_id = g.case_id AND t.direction = g.direction""")
def j4(spark, d):
    """Nearest traced endpoint, or a lead past a crossing where nothing was traced."""
    _, f = stamped(spark, d)
    return answers.direction_answers(f.where("not speculative"), f.where("speculative")).select("case_id", "direction", "nearest", "lead")


@query("j10_evidence_order", """e AS (SELECT address, ['third_party_claim', 'heuristic_inference', 'onchain_fact', 'engine_observation'][list_position(['official', 'community', 'proof', 'heuristic'], method)] AS kind, concat(source, '/', entity) AS what FROM lab),
u AS (SELECT DISTINCT * FROM e) SELECT address, string_agg(concat(kind, ':', what), ' ' ORDER BY list_position(['onchain_fact', 'third_party_claim', 'heuristic_inference', 'engine_observation'], kind), what) AS evidence FROM u GROUP BY address""")
def j10(spark, d):
    """Evidence of every labelled address in reading order; methods stand for kinds."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in (("official", "third_party_claim"), ("community", "heuristic_inference"), ("proof", "onchain_fact"), ("heuristic", "engine_observation")) for x in kv]), F.col("method"))
    e = labels(spark, d).groupBy("address").agg(F.sort_array(F.collect_set(F.struct(F.concat_ws("/", "source", "entity").alias("what"), kind.alias("kind")))).alias("e"))
    return e.select("address", F.array_join(F.transform(answers.ordered_evidence(F.col("e")), lambda x: F.concat_ws(":", x["kind"], x["what"])), " ").alias("evidence"))


@query("j12_case_report", FIND + """, pr2 AS (SELECT case_id, direction, count(*) AS reached, max(CASE WHEN hop = 0 THEN address END) AS root FROM nodes GROUP BY ALL)
SELECT case_id, direction, reached, root, CASE WHEN nearest IS NULL THEN 'none' WHEN named_address IS NOT NULL THEN 'named' ELSE 'unnamed' END AS verdict, named_entity FROM pr2 LEFT JOIN aw USING (case_id, direction)""")
def j12(spark, d):
    """Report rows of all cases."""
    nodes, f = found(spark, d)
    return answers.case_report(nodes, answers.direction_answers(f)).select("case_id", "direction", "reached", "root", "verdict", "named_entity")


@query("j5_claim_entities", r"s AS (SELECT DISTINCT concat(address, ' labeled ''', entity, '''') AS t FROM lab) SELECT t AS summary, regexp_extract(t, '^(.+?) labeled ''([^'']+)''$', 1) AS subject, regexp_extract(t, '^(.+?) labeled ''([^'']+)''$', 2) AS entity FROM s")
def j5(spark, d):
    """Entities read out of claim sentences."""
    s = labels(spark, d).select(F.concat("address", F.lit(" labeled '"), "entity", F.lit("'")).alias("summary")).distinct()
    return s.withColumn("x", answers.claim_entity(F.col("summary"))).select("summary", "x.subject", "x.entity")


@query("j6_shortfall", FIND + " SELECT dirs.case_id, dirs.direction, CASE WHEN bool_or(named) IS NULL THEN 'none' WHEN bool_or(named) THEN 'named' ELSE 'unnamed_only' END AS outcome FROM dirs LEFT JOIN fd ON dirs.case_id = fd.case_id AND dirs.direction = fd.direction GROUP BY ALL")
def j6(spark, d):
    """What each objective came to."""
    nodes, f = found(spark, d)
    return answers.shortfall(f, nodes.where("hop = 0"))


@query("j7_coverage", TRACE + """, dr AS (SELECT DISTINCT case_id, direction, parent AS address, dropped FROM e2 WHERE dropped > 0), z AS (SELECT st.*, coalesce(dropped, 0) AS dropped FROM st LEFT JOIN dr USING (case_id, direction, address))
SELECT case_id, count(*) AS reached, count(*) FILTER (state = 'expanded') AS opened, count(*) FILTER (state = 'closed') AS closed, count(*) FILTER (state = 'depth_horizon') AS depth_stops, count(*) FILTER (dropped > 0) AS capped, CAST(sum(dropped) AS BIGINT) AS dropped FROM z GROUP BY 1""")
def j7(spark, d):
    """What each trace read and did not read."""
    return answers.coverage_counters(traced(spark, d)[0]).select("case_id", "reached", "opened", "closed", "depth_stops", "capped", "dropped")


@query("j8_caveats")
def j8(spark, d):
    """Caveats of every case."""
    nodes, f = found(spark, d)
    return answers.caveats(answers.coverage_counters(nodes), answers.direction_answers(f))


@query("j9_claim_ages", "SELECT address, source, DATE '2021-01-01' - source_date AS age_days, CASE WHEN DATE '2021-01-01' < source_date THEN 'future' WHEN DATE '2021-01-01' - source_date >= 365 THEN 'stale' ELSE 'fresh' END AS age_state FROM lab")
def j9(spark, d):
    """Ages of all claims."""
    return answers.claim_ages(labels(spark, d), "2021-01-01").select("address", "source", F.col("age_days").cast("long").alias("age_days"), "age_state")


@query("j11_verdicts", FIND + " SELECT case_id, direction, CASE WHEN named_address IS NOT NULL THEN 'named' ELSE 'unnamed' END AS verdict FROM aw")
def j11(spark, d):
    """What each direction amounts to."""
    return answers.verdicts(answers.direction_answers(found(spark, d)[1])).select("case_id", "direction", "verdict")


@query("j13_quota_graph", TRACE + """, tp AS (SELECT case_id, direction, address, hop, 2 AS tier FROM nodes QUALIFY row_number() OVER (PARTITION BY case_id, direction, hop ORDER BY value DESC NULLS LAST, address) <= 5),
pn AS (SELECT case_id, direction, address, hop, parent FROM nodes WHERE address IN (SELECT address FROM lab WHERE status = 'active')),
u1 AS (SELECT n.case_id, n.direction, n.address, n.hop, n.parent FROM nodes n WHERE EXISTS (SELECT 1 FROM pn WHERE pn.case_id = n.case_id AND pn.direction = n.direction AND pn.parent = n.address)),
u2 AS (SELECT n.case_id, n.direction, n.address, n.hop FROM nodes n WHERE EXISTS (SELECT 1 FROM u1 WHERE u1.case_id = n.case_id AND u1.direction = n.direction AND u1.parent = n.address))
SELECT case_id, direction, address, hop, min(tier) AS tier FROM (FROM tp UNION ALL SELECT case_id, direction, address, hop, 0 FROM pn UNION ALL SELECT case_id, direction, address, hop, 1 FROM u1 UNION ALL SELECT *, 1 FROM u2) GROUP BY ALL""")
def j13(spark, d):
    """Nodes of each case's export: five a level, labelled ones and their ancestors."""
    pinned = labels(spark, d).where("status = 'active'")
    return answers.quota_graph(materialize(traced(spark, d)[0], "nodes"), pinned, 5).drop("chain")


@query("j14_edge_export")
def j14(spark, d):
    """Edges whose both ends the export keeps."""
    nodes, edges = traced(spark, d)
    kept = answers.quota_graph(materialize(nodes, "nodes"), labels(spark, d).where("status = 'active'"), 5)
    return answers.edge_export(edges, kept).select("case_id", "direction", "src", "dst", "hop", long("value"))


@query("j15_address_summary", SIDES + """, t AS (SELECT address, tx_hash, CAST(sum(CASE WHEN side = 'in' THEN amount ELSE 0 END) AS BIGINT) AS got, CAST(sum(CASE WHEN side = 'out' THEN amount ELSE 0 END) AS BIGINT) AS paid, max(ts) AS ts FROM sides GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts DESC, tx_hash) AS k FROM t)
SELECT address, CAST(sum(got) AS BIGINT) AS funded, CAST(sum(paid) AS BIGINT) AS spent, count(*) AS n_txs, CAST(sum(got) - sum(paid) AS BIGINT) AS balance, string_agg(CASE WHEN k <= 10 THEN concat(tx_hash, ':', CASE WHEN got >= paid THEN 'in' ELSE 'out' END) END, ',' ORDER BY k) AS recent FROM r GROUP BY address""")
def j15(spark, d):
    """Balance, totals and recent transactions of every address."""
    return answers.address_summary(facts.sides(movements(spark, d))).select("address", long("funded"), long("spent"), "n_txs", long("balance"), "recent")


@query("j17_block_summary", """b AS (SELECT CAST(ts AS DATE) AS block, tx_hash, count(*) AS n, sum(amount) AS v FROM mv GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY tx_hash) AS k FROM b)
SELECT CAST(block AS VARCHAR) AS block, count(*) AS n_txs, CAST(sum(n) AS BIGINT) AS n_movements, CAST(sum(v) AS BIGINT) AS value, string_agg(CASE WHEN k <= 12 THEN tx_hash END, ',' ORDER BY k) AS sample FROM r GROUP BY block""")
def j17(spark, d):
    """Days as blocks: totals and the first twelve transactions."""
    mv = movements(spark, d).withColumn("block", F.col("ts").cast("date"))
    return answers.block_summary(mv).select(F.col("block").cast("string").alias("block"), "n_txs", "n_movements", long("value"), "sample")


@query("j18_label_inventory", f"SELECT chain, category, count(*) AS n_labels, count(DISTINCT {STEM}) AS n_entities FROM lab WHERE status = 'active' GROUP BY CUBE (chain, category)")
def j18(spark, d):
    """Active labels by chain and category with totals."""
    return lifecycle.inventory(labels(spark, d))


@query("j19_feed_metrics", raw="""WITH c AS (SELECT event_type AS provider, CAST(user_id % 3 AS VARCHAR) AS capability, event_id AS call_id, value AS latency_ms, user_id % 10 > 0 AS ok, user_id % 7 = 0 AS fallback, user_id % 4 = 0 AS cached FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY provider, capability ORDER BY latency_ms, call_id) - 1 AS i, count(*) OVER (PARTITION BY provider, capability) AS n FROM c)
SELECT provider, capability, count(*) AS n_calls, round_even(avg(CAST(ok AS INTEGER)), 6) AS success, max(CASE WHEN i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN latency_ms END) AS p50, max(CASE WHEN i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN latency_ms END) AS p95,
max(latency_ms) AS slowest, count(*) FILTER (fallback) AS fallbacks, count(*) FILTER (cached) AS cached FROM r GROUP BY ALL""")
def j19(spark, d):
    """Latency and success by provider; the event stream stands for a call log."""
    e = table(spark, d, "events")
    calls = e.select(F.col("event_type").alias("provider"), (F.col("user_id") % 3).cast("string").alias("capability"), F.col("event_id").alias("call_id"), F.col("value").alias("latency_ms"), (F.col("user_id") % 10 > 0).alias("ok"), (F.col("user_id") % 7 == 0).alias("fallback"), (F.col("user_id") % 4 == 0).alias("cached"))
    return answers.feed_metrics(calls)


