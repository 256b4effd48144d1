"""Registered queries of traces under extended budgets that walk on past mixers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counterparties as cp, pursuit
from ..runtime import materialize
from .queries_facts import RANKED, cases, closed_by, long, query
from .views import labels, movements

#: Limits of the queries: links deep, days of crowd, candidates a mixer.
DEPTH, DAYS, FOLLOW = 3, 720, 20
#: Nodes an allowance, extensions, and where hubs are cut: tight ones end cases in the midst of a trace, wide ones leave
#: room past mixers, in traces kept narrow.
TIGHT, WIDE = (16, 3, 15, 6), (110, 8, 4, 2)
NEVER = pursuit.NEVER


def _ladder_sql(x: str, own: str, far: str, later: str, span: str) -> str:
    """CTEs of the exit ladder of one direction, named by ``x``: ``own`` is the side arrived at."""
    return f"""
an{x} AS MATERIALIZED (SELECT mixer, party, asset, amount, tx_hash, ts, gas_price FROM ev WHERE side = '{own}' QUALIFY row_number() OVER (PARTITION BY mixer, party ORDER BY amount DESC, tx_hash DESC, asset DESC, ts DESC, gas_price DESC NULLS LAST) = 1),
fa{x} AS MATERIALIZED (SELECT mixer, asset, party AS far, tx_hash AS far_tx, amount AS far_amount, ts AS far_ts, gas_price AS far_gas FROM ev WHERE side = '{far}'),
jn{x} AS MATERIALIZED (SELECT a.*, far, far_tx, far_amount, far_ts, far_gas FROM an{x} a JOIN fa{x} USING (mixer, asset) WHERE {later}),
uq{x} AS (SELECT mixer, print, party AS far FROM fp WHERE side = '{far}' QUALIFY count(*) OVER (PARTITION BY mixer, print) = 1),
ea{x} AS MATERIALIZED (SELECT mixer, party, far, far_tx, far_amount, 1 AS rung, NULL::BIGINT AS crowd FROM jn{x} WHERE far = party
  UNION ALL SELECT mixer, party, far, far_tx, far_amount, 2, NULL FROM jn{x} WHERE far <> party AND EXISTS (SELECT 1 FROM ties WHERE lo = least(far, party) AND hi = greatest(far, party))
  UNION ALL SELECT mixer, party, far, far_tx, far_amount, 3, NULL FROM jn{x} JOIN pr USING (mixer, gas_price) WHERE far_gas = gas_price
  UNION ALL SELECT j.mixer, j.party, j.far, far_tx, far_amount, 4, NULL FROM jn{x} j JOIN fp ON fp.mixer = j.mixer AND fp.party = j.party AND fp.side = '{own}' JOIN uq{x} u ON u.mixer = j.mixer AND u.print = fp.print AND u.far = j.far),
cr{x} AS (SELECT mixer, party, far, far_tx, far_amount, 5 AS rung, count(*) OVER (PARTITION BY mixer, party) AS crowd, row_number() OVER (PARTITION BY mixer, party ORDER BY far_amount DESC, abs(date_diff('microsecond', ts, far_ts)), far_tx, far) AS place
  FROM jn{x} j WHERE {span} AND NOT EXISTS (SELECT 1 FROM ea{x} e WHERE e.mixer = j.mixer AND e.party = j.party)),
al{x} AS (SELECT * FROM ea{x} UNION ALL SELECT * EXCLUDE place FROM cr{x} WHERE place <= {FOLLOW}),
cd{x} AS (SELECT mixer, party, rung, far, min(far_tx) AS far_tx, max(crowd) AS crowd, max(far_amount) AS far_amount FROM (SELECT * FROM al{x} QUALIFY rung = min(rung) OVER (PARTITION BY mixer, party)) GROUP BY ALL),
ex{x} AS (SELECT *, greatest(round_even(CASE rung WHEN 5 THEN least(0.5, 1 / crowd) ELSE [0.8, 0.7, 0.65, 0.6][rung] / count(*) OVER (PARTITION BY mixer, party) END, 3), 0.001) AS confidence FROM cd{x}),
fo{x} AS MATERIALIZED (SELECT * FROM ex{x} QUALIFY row_number() OVER (PARTITION BY mixer, party ORDER BY confidence DESC, far) <= {FOLLOW})"""


LADDERS = (
    """m AS (SELECT address AS mixer FROM stop WHERE reason = 'mixer'),
mx AS (SELECT m.mixer, asset, from_addr AS party, tx_hash, 'deposit' AS side, amount, ts, gas_price FROM mv JOIN m ON to_addr = m.mixer UNION ALL SELECT m.mixer, asset, to_addr, tx_hash, 'withdrawal', amount, ts, gas_price FROM mv JOIN m ON from_addr = m.mixer),
ev AS MATERIALIZED (SELECT mixer, asset, party, tx_hash, side, amount, ts, gas_price FROM mx WHERE party <> mixer AND party NOT IN (SELECT mixer FROM m) QUALIFY row_number() OVER (PARTITION BY mixer, asset, party, tx_hash, side ORDER BY amount DESC, ts DESC, gas_price DESC NULLS LAST) = 1),
ties AS MATERIALIZED (SELECT DISTINCT least(from_addr, to_addr) AS lo, greatest(from_addr, to_addr) AS hi FROM mv WHERE from_addr <> to_addr),
pr AS (SELECT mixer, gas_price FROM ev WHERE gas_price > 0 GROUP BY ALL HAVING count(*) FILTER (side = 'withdrawal') = 1 AND count(*) FILTER (side = 'deposit') = 1),
fp AS (SELECT mixer, party, side, string_agg(concat(asset, '=', n), ',' ORDER BY concat(asset, '=', n)) AS print FROM (SELECT mixer, party, side, asset, count(*) AS n FROM ev GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2),"""
    + _ladder_sql("f", "deposit", "withdrawal", "far_ts > ts", f"far_ts <= ts + INTERVAL {DAYS} DAY")
    + ","
    + _ladder_sql("b", "withdrawal", "deposit", "far_ts < ts", f"far_ts >= ts - INTERVAL {DAYS} DAY")
    + """,
lad AS MATERIALIZED (SELECT 'forward' AS direction, * FROM fof UNION ALL SELECT 'backward', * FROM fob)"""
)


def _found_sql(k: int, level: str, hop: int, over: int, keep: int) -> str:
    """x{k}: what the open nodes of a level at ``hop`` lead to, before it is told whether it is known."""
    cut = "" if hop == 0 else f" WHERE (rk.n <= {over} OR rk.rank <= {keep})"
    return f"""x{k} AS MATERIALIZED (SELECT o.case_id, o.direction, rk.cp AS address, {hop + 1} AS hop, rk.value, o.address AS parent, rk.tx_hash, o.basis, o.value AS pv, false AS crossing
  FROM (SELECT l.* FROM {level} l JOIN s{k - 1} s USING (case_id) WHERE s.stop IS NULL AND (l.reason IS NULL OR l.hop = 0) AND l.hop = {hop}) o JOIN rk ON rk.direction = o.direction AND rk.focus = o.address{cut})"""


def _crossed_sql(k: int, level: str, hop: str) -> str:
    """c{k}: exit candidates of a level's mixers."""
    return f"""c{k} AS MATERIALIZED (SELECT l.case_id, l.direction, far AS address, l.hop + 1 AS hop, far_amount AS value, l.address AS parent, far_tx AS tx_hash,
    ['address-match@1', 'linked-address@1', 'unique-gas-price@1', 'pool-fingerprint@1', 'anonymity-set@1'][rung] AS basis, l.value AS pv, true AS crossing
  FROM {level} l JOIN s{k - 1} s USING (case_id) JOIN lad ON lad.direction = l.direction AND lad.mixer = l.address AND lad.party = l.parent WHERE s.stop IS NULL AND l.reason = 'mixer' AND l.hop > 0 AND {hop})"""


def _admit_sql(k: int, found: str, waiting: str, nodes: int, more: int) -> str:
    """From what is found: f{k} new addresses, s{k} the cases' allowances after it, l{k} admitted, d{k} cut, a{k} all admitted."""
    return f"""f{k} AS MATERIALIZED (SELECT x.* FROM ({found}) x WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} a WHERE a.case_id = x.case_id AND a.direction = x.direction AND a.address = x.address)
  AND NOT EXISTS (SELECT 1 FROM dirs WHERE dirs.case_id = x.case_id AND dirs.root = x.address)
  QUALIFY row_number() OVER (PARTITION BY case_id, direction, address ORDER BY hop, pv DESC NULLS LAST, parent, crossing, value DESC, tx_hash) = 1),
r{k} AS MATERIALIZED (SELECT f.* EXCLUDE (pv, crossing), stop.reason, s.have + row_number() OVER (PARTITION BY case_id ORDER BY hop, value DESC NULLS LAST, address, direction) AS pos FROM f{k} f JOIN s{k - 1} s USING (case_id) LEFT JOIN stop USING (address)),
p{k} AS (SELECT case_id, count(*) AS n, count(*) FILTER (hop < {DEPTH} AND (reason IS NULL OR reason = 'mixer')) AS o, count(*) FILTER (hop < {DEPTH} AND reason = 'mixer') AS mx,
  min(pos) FILTER (reason = 'vasp' AND basis IS NULL AND direction = 'backward') AS pb, min(pos) FILTER (reason = 'vasp' AND basis IS NULL AND direction = 'forward') AS pf FROM r{k} GROUP BY ALL),
q{k} AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(o, 0) + {waiting} AS work, coalesce(mx, 0) AS mx, CASE WHEN ub THEN coalesce(pb, {NEVER}) ELSE 0 END AS tb, CASE WHEN uf THEN coalesce(pf, {NEVER}) ELSE 0 END AS tf FROM s{k - 1} s LEFT JOIN p{k} USING (case_id)),
u{k} AS (SELECT *, CASE WHEN stop IS NOT NULL OR have + n < allowance THEN 0 ELSE (have + n - allowance) // {nodes} + 1 - CAST((have + n - allowance) % {nodes} = 0 AND work = 0 AS INTEGER) END AS used FROM q{k}),
v{k} AS (SELECT *, least(used, {more} - granted, CASE WHEN greatest(tb, tf) > allowance THEN (greatest(tb, tf) - allowance + {nodes - 1}) // {nodes} ELSE 0 END) AS more FROM u{k}),
s{k} AS MATERIALIZED (SELECT case_id, least(have + n, greatest(have, allowance + more * {nodes})) AS have, allowance + more * {nodes} AS allowance, granted + more AS granted, tb > allowance + more * {nodes} AS ub, tf > allowance + more * {nodes} AS uf,
  CASE WHEN stop IS NOT NULL THEN stop WHEN used > more THEN CASE WHEN greatest(tb, tf) <= allowance + more * {nodes} THEN 'answered' ELSE 'ceiling' END END AS stop, waiting + mx AS waiting FROM v{k}),
l{k} AS MATERIALIZED (SELECT r.* EXCLUDE pos FROM r{k} r JOIN s{k} s USING (case_id) WHERE pos <= allowance),
d{k} AS (SELECT r.* EXCLUDE pos FROM r{k} r JOIN s{k} s USING (case_id) WHERE pos > allowance),
a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM l{k})"""


def _pursuit_sql(nodes: int, more: int, over: int, keep: int) -> str:
    """All CTEs: traced levels 1 to 3, leads past traced mixers (4), what leads at hop 2 lead to (5)."""
    none = "NULL::BIGINT AS value, NULL::VARCHAR AS parent, NULL::VARCHAR AS tx_hash, NULL::VARCHAR AS basis, NULL::VARCHAR AS reason"
    parts = [RANKED, LADDERS, f"a0 AS MATERIALIZED (SELECT case_id, direction, root AS address, 0 AS hop, {none} FROM dirs)"]
    parts.append(f"s0 AS MATERIALIZED (SELECT case_id, count(*) AS have, greatest({nodes}, count(*)) AS allowance, 0 AS granted, bool_or(direction = 'backward') AS ub, bool_or(direction = 'forward') AS uf, NULL::VARCHAR AS stop, 0 AS waiting FROM dirs GROUP BY case_id)")
    for hop in range(DEPTH):
        parts += [_found_sql(hop + 1, "a0" if hop == 0 else f"l{hop}", hop, over, keep), _admit_sql(hop + 1, f"SELECT * FROM x{hop + 1}", "waiting", nodes, more)]
    k = DEPTH + 1
    parts += [_crossed_sql(k, f"a{DEPTH}", f"l.hop < {DEPTH}"), _admit_sql(k, f"SELECT * FROM c{k}", "0", nodes, more)]
    parts += [_found_sql(k + 1, f"l{k}", 2, over, keep), _crossed_sql(k + 1, f"l{k}", "l.hop = 2"), _admit_sql(k + 1, f"SELECT * FROM x{k + 1} UNION ALL SELECT * FROM c{k + 1}", "0", nodes, more)]
    last = k + 1
    opened = " UNION ".join(f"SELECT case_id, direction, parent_of AS address FROM (SELECT l.case_id, l.direction, l.address AS parent_of FROM {level} l JOIN s{j - 1} s USING (case_id) WHERE s.stop IS NULL AND (l.reason IS NULL OR l.hop = 0) AND l.hop = {hop})" for j, level, hop in ((1, "a0", 0), (2, "l1", 1), (3, "l2", 2), (5, "l4", 2)))
    parts.append(f"op AS ({opened})")
    lost = " UNION ALL ".join(f"SELECT * FROM d{j}" for j in range(1, last + 1))
    parts.append(f"""lost AS (SELECT d.* FROM ({lost}) d WHERE NOT EXISTS (SELECT 1 FROM a{last} a WHERE a.case_id = d.case_id AND a.direction = d.direction AND a.address = d.address)
  QUALIFY row_number() OVER (PARTITION BY case_id, direction, address ORDER BY hop, basis IS NOT NULL, value DESC NULLS LAST, parent, basis) = 1),
pn AS (SELECT a.case_id, a.direction, a.address, hop, value, parent, tx_hash, basis, reason, CASE WHEN hop > 0 AND reason IS NOT NULL THEN 'closed' WHEN op.address IS NOT NULL THEN 'expanded' WHEN hop >= {DEPTH} THEN 'depth_horizon' ELSE 'frontier' END AS state, true AS admitted
  FROM a{last} a LEFT JOIN op ON op.case_id = a.case_id AND op.direction = a.direction AND op.address = a.address
  UNION ALL SELECT case_id, direction, address, hop, value, parent, tx_hash, basis, reason, 'frontier', false FROM lost),
ps AS (SELECT case_id, allowance, granted, have, concat_ws(',', CASE WHEN ub THEN 'backward' END, CASE WHEN uf THEN 'forward' END) AS unanswered, CASE WHEN stop IS NOT NULL THEN stop WHEN have < allowance THEN 'completed' WHEN ub OR uf THEN 'frontier_empty' ELSE 'answered' END AS stop FROM s{last})""")
    edges = " UNION ".join(f"SELECT case_id, direction, parent AS src, address AS dst, hop, value, tx_hash, crossing FROM x{j}" for j in (1, 2, 3, 5))
    told = lambda j: f"SELECT case_id, direction, parent AS src, address AS dst, hop, value, tx_hash, crossing FROM c{j} c WHERE NOT EXISTS (SELECT 1 FROM a{j - 1} a WHERE a.basis IS NULL AND a.case_id = c.case_id AND a.direction = c.direction AND a.address = c.address) AND NOT EXISTS (SELECT 1 FROM dirs WHERE dirs.case_id = c.case_id AND dirs.root = c.address)"
    parts.append(f"pe AS ({edges} UNION {told(k)} UNION {told(last)})")
    return ",\n".join(parts)


def pursued(spark, d, nodes: int, more: int, over: int, keep: int) -> pursuit.Pursuit:
    """All cases, three links deep, 720 days of crowd."""
    c = cp.expand_objectives(cases(spark, d)).select("case_id", "chain", "root", "direction")
    mv = materialize(movements(spark, d), "movements")
    return pursuit.pursue(c, mv, closed_by(labels(spark, d)), DEPTH, nodes, more, over, keep, DAYS, FOLLOW)


STOPS = " SELECT case_id, allowance, granted, have, unanswered, stop FROM ps"
TOLD = " SELECT case_id, direction, address, hop, value, parent, tx_hash, basis, reason, state, admitted FROM pn"


def _stops(p: pursuit.Pursuit):
    return p.stops.select("case_id", "allowance", "granted", "have", F.array_join("unanswered", ",").alias("unanswered"), "stop")


def _told(p: pursuit.Pursuit):
    return p.nodes.select("case_id", "direction", "address", "hop", long("value"), "parent", "tx_hash", "basis", "reason", "state", "admitted")


@query("c6_pursued_trace", _pursuit_sql(*TIGHT) + TOLD)
def c6p(spark, d):
    """Every address that the cases reach under tight budgets that grow while a direction has no answer."""
    return _told(pursued(spark, d, *TIGHT))


@query("c6_pursuit_stops", _pursuit_sql(*TIGHT) + STOPS)
def c6s(spark, d):
    """What each case was allowed and used under tight budgets, how often it was extended, and why it stopped."""
    return _stops(pursued(spark, d, *TIGHT))


@query("c6_wide_stops", _pursuit_sql(*WIDE) + STOPS)
def c6w(spark, d):
    """The same under wide budgets, which some cases do not use up."""
    return _stops(pursued(spark, d, *WIDE))


@query("h11_pursued_leads", _pursuit_sql(*WIDE) + TOLD)
def h11n(spark, d):
    """Every address that the cases reach under wide budgets, past mixers too, with the basis of what lies past one."""
    return _told(pursued(spark, d, *WIDE))


@query("h11_pursuit_edges", _pursuit_sql(*WIDE) + " SELECT case_id, direction, src, dst, hop, value, tx_hash, crossing FROM pe")
def h11p(spark, d):
    """Edges that the cases walk under wide budgets; those over a mixer are crossings."""
    return pursued(spark, d, *WIDE).edges.select("case_id", "direction", "src", "dst", "hop", long("value"), "tx_hash", "crossing")


@query(
    "h12_stamped_findings",
    _pursuit_sql(*WIDE)
    + """, cl AS (SELECT address, CASE category WHEN 'vasp' THEN 'vasp_endpoint' WHEN 'mixer' THEN 'mixer_exposure' ELSE 'sanctions_exposure' END AS kind, confidence, entity FROM lab WHERE status = 'active' AND category IN ('vasp', 'mixer', 'sanctioned')
  QUALIFY row_number() OVER (PARTITION BY address, category ORDER BY confidence DESC, entity DESC) = 1)
SELECT case_id, direction, address, hop, kind, entity, confidence, basis IS NOT NULL AS speculative, basis,
  concat(kind, ' ', entity, CASE WHEN basis IS NOT NULL THEN concat('; past a mixer by ', basis, ', may be an unrelated party''s') ELSE '' END) AS summary FROM pn JOIN cl USING (address) WHERE admitted AND hop > 0""",
)
def h12s(spark, d):
    """Findings of labels on every node, each one past a mixer stamped with the basis of its branch."""
    return pursuit.stamped_findings(pursued(spark, d, *WIDE).nodes, labels(spark, d)).drop("chain")
