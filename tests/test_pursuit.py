"""Traces under extended budgets past mixers, against a walk that admits one node at a time."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from test_ledgers import MV, rows
from trailspark.operators import mixers, pursuit

CASES = "case_id string, chain string, root string, direction string"
CLOSED = "chain string, address string, reason string"


def paid(k, a, b, amount, day=0, verified=True):
    at = datetime(2024, 1, 1) + timedelta(days=day)
    return ("c", f"t{k}", "k", 0, "token", "N", verified, Decimal(amount), str(amount), a, b, at, None)


def walk(moves, cases, closed, ladder, depth, base, most, over, keep):
    """(nodes, stops): each case alone, one node at a time; ``ladder`` gives (far, value, tx, basis) of (direction, mixer, party)."""
    value = {"forward": {}, "backward": {}}
    largest = {}
    for r in moves:
        for d, a, b in (("forward", r[9], r[10]), ("backward", r[10], r[9])):
            if a and b and a != b:
                of = value[d].setdefault(a, {})
                of[b] = of.get(b, 0) + (int(r[7]) if r[6] else 0)
                mine = (len(r[8]), r[8], r[11], r[1])
                largest[d, a, b] = max(largest.get((d, a, b), mine), mine)
    nodes, stops = [], []
    for case in sorted({c[0] for c in cases}):
        asked = sorted({(d, root) for c, _, root, d in cases if c == case})
        roots = {root for _, root in asked}
        known = {(d, root): dict(hop=0, value=None, parent=None, basis=None, reason=None, order=i) for i, (d, root) in enumerate(asked)}
        cut, opened = {}, set()
        s = dict(have=len(known), allowance=max(base, len(known)), granted=0, open={d for d, _ in asked}, stop=None)

        def exhausted():
            if not s["open"]:
                s["stop"] = "answered"
            elif s["granted"] == most:
                s["stop"] = "ceiling"
            else:
                s["granted"] += 1
                s["allowance"] += base

        def admit(found, work):
            """Found nodes in claim order; ``work`` tells whether anything else waits."""
            best = {}
            for n in found:
                at = (n["d"], n["address"])
                if at in known or n["address"] in roots:
                    continue
                rank = (n["hop"], -(n["pv"] if n["pv"] is not None else -1), n["parent"], n["crossing"], -n["value"], n["tx"])
                if at not in best or rank < best[at][0]:
                    best[at] = (rank, n)
            level = sorted((n for _, n in best.values()), key=lambda n: (n["hop"], -n["value"], n["address"], n["d"]))
            got = []
            for n in level:
                told = dict(hop=n["hop"], value=n["value"], parent=n["parent"], basis=n["basis"], reason=closed.get(n["address"]))
                if s["stop"] is None and s["have"] >= s["allowance"]:
                    exhausted()
                if s["stop"]:
                    cut.setdefault((n["d"], n["address"]), []).append(told)
                    continue
                s["have"] += 1
                known[n["d"], n["address"]] = told
                got.append((n["d"], n["address"]))
                if told["reason"] == "vasp" and told["basis"] is None:
                    s["open"].discard(n["d"])
            left = any(known[x]["hop"] < depth and known[x]["reason"] in (None, "mixer") for x in got)
            if s["stop"] is None and s["have"] >= s["allowance"] and (left or work()):
                exhausted()
            return got

        def expand(level, hop):
            found = []
            for d, a in level:
                if s["stop"] is None and (known[d, a]["reason"] is None or hop == 0):
                    opened.add((d, a))
                    parties = sorted(value[d].get(a, {}).items(), key=lambda x: (-x[1], x[0]))
                    for b, v in parties[:keep] if hop and len(parties) > over else parties:
                        found.append(dict(d=d, address=b, hop=hop + 1, value=v, parent=a, tx=largest[d, a, b][3], basis=known[d, a]["basis"], pv=known[d, a]["value"], crossing=False))
            return found

        def cross(level):
            found = []
            for d, a in level:
                n = known[d, a]
                if s["stop"] is None and n["reason"] == "mixer" and 0 < n["hop"] < depth:
                    for far, v, tx, basis in ladder.get((d, a, n["parent"]), []):
                        found.append(dict(d=d, address=far, hop=n["hop"] + 1, value=v, parent=a, tx=tx, basis=basis, pv=n["value"], crossing=True))
            return found

        level = list(known)
        for hop in range(depth):
            level = admit(expand(level, hop), lambda: any(n["reason"] == "mixer" and 0 < n["hop"] < depth for n in known.values()))
        leads = admit(cross(list(known)), lambda: False)
        level = []
        for hop in range(2, depth):
            here = [x for x in leads if known[x]["hop"] == hop] + level
            found = expand(here, hop) + cross(here)
            level = admit(found, lambda: any(hop < known[x]["hop"] < depth for x in leads))  # noqa: B023
        for (d, a), n in known.items():
            state = "closed" if n["hop"] and n["reason"] else "expanded" if (d, a) in opened else "depth_horizon" if n["hop"] >= depth else "frontier"
            nodes.append((case, d, a, n["hop"], n["value"], n["parent"], n["basis"], state, True))
        for (d, a), all_ in cut.items():
            n = min(all_, key=lambda n: (n["hop"], n["basis"] is not None, -n["value"], n["parent"], n["basis"] or ""))
            nodes.append((case, d, a, n["hop"], n["value"], n["parent"], n["basis"], "frontier", False))
        full = s["have"] >= s["allowance"]
        stops.append((case, s["allowance"], s["granted"], s["have"], sorted(s["open"]), s["stop"] or ("completed" if not full else "frontier_empty" if s["open"] else "answered")))
    return sorted(nodes, key=str), stops


def ladder_of(spark, df, closed, days):
    """The ladder's own candidates for every anchor; what a trace makes of them is under test, not the ladder."""
    mix = spark.createDataFrame([("c", a) for a, r in closed.items() if r == "mixer"], "chain string, address string")
    events = mixers.activity(df, mix)
    names, out = {k: n for k, (n, _) in mixers.RUNGS.items()}, {}
    for d in ("backward", "forward"):
        got = mixers.exits(df, events, mixers.anchors(events, d), d, days).collect()
        for r in sorted(got, key=lambda r: (-r["confidence"], r["far"])):
            mine = out.setdefault((d, r["mixer"], r["party"]), [])
            if len(mine) < 20:
                mine.append((r["far"], int(r["far_amount"]), r["far_tx"], names[r["rung"]]))
    return out


@pytest.fixture(scope="module")
def web(spark):
    """Sparse payments of 130 addresses through four mixers, and labels."""
    rng = random.Random(11)
    closed = {f"m{k}": "mixer" for k in range(4)} | {f"a{k}": "vasp" for k in (17, 40, 77)}
    moves = [paid(k, f"a{rng.randrange(130)}", f"a{rng.randrange(130)}", rng.randrange(1, 900), rng.randrange(40), rng.random() < 0.9) for k in range(170)]
    for k in range(60):
        ends = (f"m{rng.randrange(4)}", f"a{rng.randrange(130)}")
        moves.append(paid(f"m{k}", *(ends if k % 2 else ends[::-1]), rng.randrange(1, 900), rng.randrange(40)))
    df = spark.createDataFrame(moves, MV)
    return moves, df, closed, ladder_of(spark, df, closed, 30)


@pytest.mark.parametrize("base,most,depth", [(5, 2, 3), (500, 8, 4)])
def test_against_a_walk(spark, web, base, most, depth):
    moves, df, closed, ladder = web
    cases = [(f"k{k}", "c", f"a{k}", d) for k in range(12) for d in ("backward", "forward")]
    got = pursuit.pursue(spark.createDataFrame(cases, CASES), df, spark.createDataFrame([("c", a, r) for a, r in closed.items()], CLOSED), depth, base, most, 6, 2, 30)
    nodes, stops = walk(moves, cases, closed, ladder, depth, base, most, 6, 2)
    told = sorted(((*r[:4], None if r[4] is None else int(r[4]), *r[5:]) for r in map(tuple, got.nodes.select("case_id", "direction", "address", "hop", "value", "parent", "basis", "state", "admitted").collect())), key=str)
    assert told == nodes
    assert [(*r[:4], list(r[4]), r[5]) for r in rows(got.stops, "case_id", "allowance", "granted", "have", "unanswered", "stop")] == stops
    if base == 500:  # leads two hops past a crossing occur
        crossed = {(r["case_id"], r["direction"], r["dst"]) for r in got.edges.where("crossing").collect()}
        assert any(n[6] and (n[0], n[1], n[5]) in crossed for n in nodes)


def test_every_way_to_stop(spark):
    moves = [paid(1, "r", "a", 9), paid(2, "a", "b", 8), paid(3, "b", "c", 7), paid(4, "s", "v", 9), paid(5, "s", "w", 8)] + [paid(f"p{k}", "p", f"p{k}", k) for k in range(1, 5)]
    cases = spark.createDataFrame([("ceiling", "c", "p", "forward"), ("answered", "c", "s", "forward"), ("empty", "c", "r", "forward"), ("done", "c", "b", "forward"), ("none", "c", None, "forward"), ("odd", "c", "r", "sideways")], CASES)
    got = pursuit.pursue(cases, spark.createDataFrame(moves, MV), spark.createDataFrame([("c", "v", "vasp")], CLOSED), max_depth=2, max_nodes=3, max_extensions=0)
    assert {r["case_id"]: r["stop"] for r in got.stops.collect()} == {"ceiling": "ceiling", "answered": "answered", "empty": "frontier_empty", "done": "completed"}
    assert rows(got.nodes.where("not admitted"), "case_id", "address") == [("ceiling", "p1"), ("ceiling", "p2")]


def test_a_lead_answers_nothing_and_its_findings_are_stamped(spark):
    df = spark.createDataFrame([paid(1, "r", "m", 500, 1), paid(2, "m", "x", 500, 2), paid(3, "x", "v", 400, 3)], MV)
    closed = spark.createDataFrame([("c", "m", "mixer"), ("c", "v", "vasp")], CLOSED)
    labels = spark.createDataFrame([("c", "m", "mixer", "active", 0.9, "Pool"), ("c", "v", "vasp", "active", 0.8, "Desk"), ("c", "v", "vasp", "retired", 0.9, "Old")], "chain string, address string, category string, status string, confidence double, entity string")
    got = pursuit.pursue(spark.createDataFrame([("k", "c", "r", "forward")], CASES), df, closed, max_depth=4)
    told = {r["address"]: (r["kind"], r["entity"], r["speculative"], r["basis"]) for r in pursuit.stamped_findings(got.nodes, labels).collect()}
    assert told == {"m": ("mixer_exposure", "Pool", False, None), "v": ("vasp_endpoint", "Desk", True, "anonymity-set@1")}
    assert rows(got.stops, "unanswered", "stop") == [(["forward"], "completed")]


def test_empty_tables(spark):
    df, none = spark.createDataFrame([], MV), spark.createDataFrame([], CLOSED)
    got = pursuit.pursue(spark.createDataFrame([], CASES), df, none)
    assert got.nodes.count() == got.edges.count() == got.stops.count() == 0
    got = pursuit.pursue(spark.createDataFrame([("k", "c", "r", "forward")] * 2, CASES), df, none)
    assert rows(got.nodes, "address", "state") == [("r", "expanded")] and rows(got.stops, "stop") == [("completed",)]


def test_movements_with_both_ends_are_not_written_again(spark, monkeypatch):
    written, real = [], pursuit.materialize
    monkeypatch.setattr(pursuit, "materialize", lambda df, name, *a: written.append(name) or real(df, name, *a))
    cases = spark.createDataFrame([("k", "c", "r", "forward")], "case_id string, chain string, root string, direction string")
    df = spark.createDataFrame([("c", "1", 0, "N", True, Decimal(5), "5", "r", "a", None, None)], "chain string, tx_hash string, idx int, asset string, verified boolean, amount decimal(38,0), amount_str string, from_addr string, to_addr string, ts timestamp, gas_price decimal(38,0)")
    got = pursuit.pursue(cases, df, spark.createDataFrame([], "chain string, address string, reason string"), 2)
    assert sorted(r["address"] for r in got.nodes.collect()) == ["a", "r"]
    assert not {"pursuit-backward", "pursuit-forward"} & set(written)
