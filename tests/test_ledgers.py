"""Micro-ledgers, one a rule, with expected rows written by hand."""

import json
import os
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailspark import runtime
from trailspark.functions import scalars
from trailspark.operators import answers, clusters, counterparties as cp, detectors, facts, knowledge, lifecycle, paths
from trailspark.operators.components import connected_components
from trailspark.plans import queries_ingest
from trailspark.sources import documents, ledgers

MV = "chain string, tx_hash string, dedup_key string, idx int, kind string, asset string, verified boolean, amount decimal(38,0), amount_str string, from_addr string, to_addr string, ts timestamp, gas_price decimal(38,0)"


def move(tx, a, b, amount, ts="2024-01-01 00:00:00", asset="N", verified=True, idx=0, kind="token", key=None):
    return ("c", tx, key or f"k{idx}", idx, kind, asset, verified, Decimal(amount), str(amount), a, b, pd.Timestamp(ts).to_pydatetime(), None)


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), MV)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_write_and_nulls(spark):
    df = ledger(spark, move("t", "a", "b", 5), move("t", "a", "b", 3), move("u", None, "b", 1))
    kept = facts.first_write(df, ["amount"])
    assert rows(kept, "tx_hash", "amount") == [("t", Decimal(3)), ("u", Decimal(1))]
    assert facts.first_write(df.limit(0), ["amount"]).count() == 0


def test_spam_cannot_steer(spark):
    df = ledger(spark, move("1", "spam", "root", 10**30, asset="X", verified=False), move("2", "real", "root", 7), move("3", "root", "root", 9))
    got = cp.ranked(cp.counterparties(df, "backward"))
    assert rows(got, "counterparty", "value", "rank") == [("real", Decimal(7), 1), ("spam", Decimal(0), 2)]


def test_utxo_inputs_stand_for_a_missing_sender(spark):
    df = ledger(spark, move("t", "in1", None, 3, kind="utxo_input", idx=0), move("t", "in2", None, 4, kind="utxo_input", idx=1), move("t", None, "x", 6, kind="utxo_output", idx=2), move("t", None, "x", 1, kind="utxo_output", idx=3))
    assert rows(cp.counterparties(df, "backward"), "focus", "counterparty", "value") == [("x", "in1", Decimal(3)), ("x", "in2", Decimal(4))]


def test_trace_cycle_cap_and_labels(spark):
    df = ledger(spark, move("1", "root", "a", 9), move("2", "root", "b", 5), move("3", "a", "c", 4), move("4", "b", "c", 3), move("5", "c", "root", 2), move("6", "b", "vasp", 1), move("7", "vasp", "z", 1))
    cases = spark.createDataFrame([("k", "c", "root", ["find_next_vasp", "unknown"])], "case_id string, chain string, root string, objectives array<string>")
    closed = spark.createDataFrame([("c", "vasp", "vasp")], "chain string, address string, reason string")
    nodes, edges = cp.trace(cp.expand_objectives(cases), df, closed, 3)
    got = {r["address"]: (r["hop"], r["parent"], r["state"]) for r in nodes.collect()}
    assert got == {"root": (0, None, "expanded"), "a": (1, "root", "expanded"), "b": (1, "root", "expanded"), "c": (2, "a", "expanded"), "vasp": (2, "b", "closed")}
    assert ("c", "root") in {(r["src"], r["dst"]) for r in edges.collect()}
    path = {r["address"]: r["path"] for r in cp.shortest_paths(nodes, 3).collect()}
    assert path["c"] == ["1", "3"] and path["root"] == []


def walked(moves, roots, closed, depth=3, over=50, keep=20):
    """Rows (case, direction, address, hop, value, parent, state) of traces, one address at a time."""
    value = {"forward": {}, "backward": {}}
    for r in moves:
        for direction, a, b in (("forward", r["from_addr"], r["to_addr"]), ("backward", r["to_addr"], r["from_addr"])):
            if a is not None and b is not None and a != b:
                of = value[direction].setdefault(a, {})
                of[b] = of.get(b, 0) + (int(r["amount"]) if r["verified"] else 0)
    out = []
    for case, direction, root in roots:
        known = {root: (0, None, None)}
        level = [root]
        state = {}
        for hop in range(depth + 1):
            following = []
            for a in sorted(level, key=lambda a: (-(known[a][1] or 0), a)):
                state[a] = "closed" if hop and a in closed else "depth_horizon" if hop == depth else "expanded"
                if state[a] == "expanded":
                    parties = sorted(value[direction].get(a, {}).items(), key=lambda x: (-x[1], x[0]))
                    for b, v in parties[:keep] if hop and len(parties) > over else parties:
                        if b not in known:
                            known[b] = (hop + 1, v, a)
                            following.append(b)
            level = following
        out += [(case, direction, a, *known[a], state[a]) for a in known]
    return sorted(out, key=str)


def test_trace_at_its_own_depth_and_cap_against_a_walk(spark):
    rng = random.Random(5)
    moves = [move(str(k), f"a{rng.randrange(90)}", rng.choice(["hub", f"a{rng.randrange(90)}"]), rng.randrange(1, 1000), verified=rng.random() < 0.9) for k in range(300)]
    moves += [move(f"h{k}", "hub", f"x{k}", rng.randrange(1, 9)) for k in range(60)] + [move(f"y{k}", f"x{k}", f"z{k}", 1) for k in range(60)]
    df = ledger(spark, *moves)
    roots = [(f"k{k}", direction, f"a{k}") for k in range(8) for direction in ("backward", "forward")]
    cases = spark.createDataFrame([(c, "c", a, d) for c, d, a in roots], "case_id string, chain string, root string, direction string")
    nodes, _ = cp.trace(cases, df, spark.createDataFrame([("c", "a20", "vasp")], "chain string, address string, reason string"))
    got = sorted(map(tuple, nodes.select("case_id", "direction", "address", "hop", F.col("value").cast("long"), "parent", "state").collect()), key=str)
    assert got == walked(df.collect(), roots, {"a20"}) and max(r[3] for r in got) == 3


def test_registered_trace_goes_the_whole_depth(spark):
    from trailspark.plans import queries_facts, registry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    got = sorted(map(tuple, registry.QUERIES["c4_deep_trace"](spark, d).collect()), key=str)
    keys = [r["s_suppkey"] for r in spark.read.parquet(f"{d}/supplier.parquet").collect()]
    n = spark.read.parquet(f"{d}/orders.parquet").count() * 2 // 5
    closed = {r["address"] for r in queries_facts.closed_by(queries_facts.labels(spark, d)).collect()}
    roots = [(f"case-s{k}", direction, f"A{k % n}") for k in keys for direction in ("backward", "forward")]
    assert got == walked(queries_facts.movements(spark, d).collect(), roots, closed) and max(r[3] for r in got) == 3


def test_trace_budget_leaves_a_frontier(spark):
    df = ledger(spark, *[move(str(i), "root", f"a{i}", 10 - i) for i in range(4)], *[move(f"n{i}", f"a{i}", f"b{i}", 1) for i in range(4)])
    cases = spark.createDataFrame([("k", "c", "root", "forward")], "case_id string, chain string, root string, direction string")
    nodes, _ = cp.trace(cases, df, None, 2, max_opened=3)
    state = {r["address"]: r["state"] for r in nodes.collect()}
    assert state["a0"] == state["a1"] == "expanded" and state["a2"] == state["a3"] == "frontier"


def sequential(rows_, low, high, width, same_tx):
    """The matcher's rule, step by step: receipts in order take the earliest unused fitting send."""
    key = lambda r: (r["us"], r["tx_hash"], r["idx"])
    ins, outs = (sorted((r for r in rows_ if r["side"] == s), key=key) for s in ("in", "out"))
    used, pairs = set(), []
    for i in ins:
        for n, o in enumerate(outs):
            if n in used or o["us"] < i["us"] or o["us"] - i["us"] > width or (not same_tx and o["tx_hash"] == i["tx_hash"]) or not low * i["value"] <= o["value"] <= high * i["value"]:
                continue
            used.add(n)
            pairs.append((i["tx_hash"], o["tx_hash"]))
            break
    return pairs


def test_matcher_against_the_rule():
    rng = random.Random(3)
    for _ in range(40):
        g = [{"side": rng.choice(["in", "out"]), "us": rng.randrange(40), "tx_hash": f"t{rng.randrange(30)}", "idx": k, "value": float(rng.randrange(90, 110))} for k in range(25)]
        pdf = pd.DataFrame(g)
        for low, high, same in ((0.95, 1.0, False), (0.0, float("inf"), True)):
            got = [(pdf.loc[i, "tx_hash"], pdf.loc[k, "tx_hash"]) for i, k in detectors.match_group(pdf, low, high, 12, same)]
            assert got == sequential(g, low, high, 12, same)


def test_sweep_and_peel(spark):
    df = ledger(
        spark, move("r1", "s", "x", 100, "2024-01-01 00:00:00"), move("o1", "x", "d", 97, "2024-01-01 01:00:00"), move("o2", "x", "d", 96, "2024-01-01 02:00:00"),
        move("r2", "s", "p", 100, "2024-01-02 00:00:00"), move("o3", "p", "q", 80, "2024-01-02 01:00:00"), move("o4", "p", "w", 15, "2024-01-02 02:00:00"),
    )
    w = facts.comparable_window(df)
    assert rows(detectors.sweep_pairs(w), "address", "in_tx", "out_tx") == [("x", "r1", "o1")]
    found = detectors.sweep_findings(detectors.sweep_pairs(w)).collect()[0]
    assert found["n_pairs"] == 1 and found["refs"] == "o1,r1" and 0.9 < found["confidence"] <= 0.95
    assert rows(detectors.peel_chain(w), "address", "ratio", "confidence") == [("p", 0.8, 0.75)]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (999, 999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cospend_refusals(spark):
    def tx(name, ins, outs):
        return [move(name, a, None, 10, kind="utxo_input", idx=i, key=f"in:{i}") for i, a in enumerate(ins)] + [move(name, None, f"o{name}{i}", v, kind="utxo_output", idx=9 + i, key=f"out:{i}") for i, v in enumerate(outs)]

    df = ledger(spark, *tx("1", "ab", [5, 4]), *tx("2", "bc", [7]), *tx("3", "xyz", [3, 3]), *tx("4", "pm", [1]), *tx("5", "q", [2]))
    mixers = spark.createDataFrame([("c", "m")], "chain string, address string")
    assert rows(clusters.judged(clusters.spending(df), df, mixers), "tx_hash", "verdict") == [("1", "joined"), ("2", "joined"), ("3", "coinjoin"), ("4", "mixer"), ("5", "single")]
    got = clusters.cospend_clusters(df, mixers)
    assert rows(got, "address", "cluster") == [("a", "a"), ("b", "a"), ("c", "a")]
    lab = spark.createDataFrame([("c", "a", "X", 0.8, "active")], "chain string, address string, entity string, confidence double, status string")
    assert rows(clusters.proposals(got, lab), "address", "entity", "confidence", "refused") == [("b", "X", 0.72, False), ("c", "X", 0.72, False)]
    two = lab.union(spark.createDataFrame([("c", "c", "Y", 0.9, "active")], lab.schema))
    assert rows(clusters.proposals(got, two), "address", "refused") == [("b", True)]


def test_hex_and_base58(spark):
    big = [0, 1, 10**18, 2**126, 10**38 - 1, 10**38, 2**255]
    df = spark.createDataFrame([(hex(v), str(v)) for v in big] + [("zz", None), (None, None)], "h string, v string")
    got = df.select("v", scalars.hex_to_decimal(F.col("h")).cast("string").alias("d"), scalars.hex_to_digits("h").alias("x")).collect()
    for r in got:
        assert r["d"] == (r["v"] if r["v"] and int(r["v"]) < 10**38 else None) and r["x"] == r["v"]
    one = spark.createDataFrame([("41a614f803b6fd780986a42c78ec9c7f77e6ded13c",), ("nonsense",)], "h string")
    assert rows(scalars.with_base58(one, "h", "a"), "a") == [("TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t",), ("nonsense",)]


def test_entity_stem(spark):
    names = {"Binance 14": "binance", "Kraken (hot)": "kraken", "OKX-3": "okx", "123 - 4": "", "Big   Exchange_2": "big exchange"}
    df = spark.createDataFrame([(k,) for k in names], "entity string")
    assert {r[0]: r[1] for r in df.select("entity", knowledge.entity_stem(F.col("entity"))).collect()} == names


def test_reconcile_earns_and_loses_status(spark):
    s = "chain string, address string, source string, status string, entity string, category string, role string, confidence double, method string, source_date string"
    df = spark.createDataFrame(
        [("c", "1", "good", "active", "Acme 1", "vasp", "hot", 0.9, "official", None), ("c", "1", "tip", "pending", "ACME", "vasp", "hot", 0.3, "community", None), ("c", "2", "tip", "active", "Solo", "vasp", "hot", 0.3, "community", None), ("c", "1", "off", "pending", "Acme", "mixer", "hot", 0.3, "community", None)], s
    )
    labels, events = lifecycle.reconcile(df)
    assert rows(labels, "address", "source", "status") == [("1", "good", "active"), ("1", "off", "pending"), ("1", "tip", "active"), ("2", "tip", "pending")]
    assert rows(events.where("kind = 'promoted'"), "source", "corroborated_by") == [("tip", "good")]


def test_sanctions_document_cut_short_is_refused(spark):
    entry = '<sdnEntry><uid>1</uid><lastName>Evil</lastName><programList><program>P</program></programList><idList><id><idType>Digital Currency Address - USDT</idType><idNumber>TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t</idNumber></id><id><idType>Passport</idType><idNumber>9</idNumber></id></idList></sdnEntry>'
    head = "<sdnList><publshInformation><Publish_Date>08/18/2024</Publish_Date></publshInformation>"
    docs = spark.createDataFrame([("ok", head + entry + entry + "</sdnList>\n"), ("cut", head + entry), ("undated", "<sdnList>" + entry + "</sdnList>")], "path string, content string")
    claims, bad = documents.sanctions(docs)
    assert rows(claims, "path", "chain", "entity") == [("ok", "tron", "Evil (P)")]
    assert {r["path"]: r["reasons"] for r in bad.collect()} == {"cut": ["open"], "undated": ["date"]}


def test_reserve_table_counts(spark):
    text = 'Coin,Balance\nBTC,1\n\nNetwork,Address,Message,Sig\nETH,0xab,m,s\nDOGE,D1,m,s\nBTC,,m,s\n'
    docs = spark.createDataFrame([("a", text), ("b", "nothing here")], "path string, content string")
    claims, counts = documents.reserves(docs, "E", "s", "2024-01-01")
    assert rows(claims, "chain", "address") == [("ethereum", "0xab")]
    assert rows(counts, "path", "empty", "unsupported", "kept", "refused") == [("a", 1, 1, 1, False), ("b", 0, 0, 0, True)]


def test_balances_sum_to_the_fee(spark):
    token = "array<struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string,decimals:int>>>"
    schema = f"signature string, slot long, blockTime long, meta struct<err:string,fee:long,preBalances:array<long>,postBalances:array<long>,preTokenBalances:{token},postTokenBalances:{token}>, transaction struct<message:struct<accountKeys:array<struct<pubkey:string>>>>"
    keys = (([("A",), ("B",)],),)
    txs = [("s1", 1, 1, (None, 5, [100, 0], [65, 30], [(1, "M", "B", ("10", 6))], []), keys), ("s2", 1, 1, ("bad", 5, [9, 9], [1, 1], [], []), keys), ("s3", 1, 1, (None, 5, [9], [1, 1], [], []), keys)]
    got = ledgers.balance_deltas(spark.createDataFrame(txs, schema))
    assert rows(got, "tx_hash", "kind", "amount", "asset_kind") == [("s1", "utxo_input", Decimal(10), "token"), ("s1", "utxo_input", Decimal(30), "native"), ("s1", "utxo_output", Decimal(30), "native")]


def test_answers_prefer_the_unnamed_on_a_tie(spark):
    f = spark.createDataFrame([("k", "forward", "a", 2, True, "E", 0.9), ("k", "forward", "b", 2, False, None, 0.6), ("k", "forward", "c", 1, False, None, 0.1)], "case_id string, direction string, address string, hop int, named boolean, entity string, confidence double")
    one = answers.direction_answers(f.where("address <> 'c'")).first()
    assert (one["nearest"], one["named_address"]) == ("b", "a")
    assert answers.direction_answers(f).first()["nearest"] == "c"


def test_valued_takes_the_latest_price(spark):
    df = ledger(spark, move("1", "a", "b", 2, "2024-01-05 00:00:00"), move("2", "a", "b", 2, "2024-04-05 00:00:00"), move("3", "a", "b", 2, "2023-01-05 00:00:00"), move("4", "a", "b", 2, asset="Z"))
    p = spark.createDataFrame([("N", pd.Timestamp("2024-01-04").to_pydatetime(), 3.0), ("N", pd.Timestamp("2024-01-06").to_pydatetime(), 5.0)], "asset string, day timestamp, price double")
    assert rows(knowledge.valued(df, p), "tx_hash", "usd") == [("1", 6.0), ("2", 10.0), ("3", 0.0), ("4", 0.0)]


def test_streams_equal_batch(spark, tmp_path):
    from trailspark.streaming import jobs

    df = ledger(spark, *[move(f"t{i % 7}", "a", "b", i, f"2024-01-01 00:{i:02d}:00") for i in range(20)])
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    q = jobs.ingest(jobs.source(spark, f"{tmp_path}/in", df.schema, 1), f"{tmp_path}/table", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/table"), "tx_hash") == [(f"t{i}",) for i in range(7)]


def test_streams_keep_rows_of_any_age(spark, tmp_path):
    from trailspark.streaming import jobs

    for year in range(2001, 1994, -1):  # a file a micro-batch, each older than the last, and replays
        made = [move(f"t{year}-{i}", "a", f"b{i % 3}", i, f"{year}-06-01 00:{i:02d}:00") for i in range(5)] + [move("again", "a", "b", 1, f"{year}-01-01 00:00:00"), move(None, "a", "b", 1, f"{year}-01-01 00:00:00")]
        ledger(spark, *made).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = jobs.source(spark, f"{tmp_path}/in", ledger(spark, move("t", "a", "b", 1)).schema, 1)
    q = jobs.ingest(source, f"{tmp_path}/table", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(str(r["tx_hash"]) for r in spark.read.parquet(f"{tmp_path}/table").collect())
    assert got == sorted([f"t{y}-{i}" for y in range(1995, 2002) for i in range(5)] + ["again", "None"])
    q = jobs.activity(source, f"{tmp_path}/counts", f"{tmp_path}/counts-state", "from_addr", "to_addr", "1 hour", "1 hour").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r["window"]["start"]), r["others"], r["n"]) for r in jobs.activity_read(spark, f"{tmp_path}/counts", "from_addr").collect())
    assert got == sorted(x for y in range(1995, 2002) for x in ((f"{y}-01-01 00:00:00", 1, 2), (f"{y}-06-01 00:00:00", 3, 5)))


def test_relay_stream_equals_the_rule(spark, tmp_path):
    from trailspark.streaming import jobs

    rng = random.Random(4)
    events = [(f"a{rng.randrange(3)}", "N", rng.choice(["in", "out"]), pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(minutes=m).to_pytimedelta()) for m in range(0, 240, 3)]
    spark.createDataFrame(events, "address string, asset string, side string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = jobs.relays(jobs.source(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")).start()
    q.awaitTermination()
    got = sorted((r["address"], r["in_us"], r["out_us"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for a in {e[0] for e in events}:
        wait = []
        for us, side in sorted((int(pd.Timestamp(t).value // 1000), s) for x, _, s, t in events if x == a):
            wait = [t for t in wait if us - t <= 1800 * 1_000_000]
            if side == "in":
                wait.append(us)
            elif wait:
                want.append((a, wait.pop(0), us))
    assert got == sorted(want)


def test_resume_is_refused_when_spent(spark):
    df = spark.createDataFrame([("a", "partial", 10, 4), ("b", "done", 10, 4), ("c", "partial", 4, 4)], "case_id string, status string, max_nodes long, spent_nodes long")
    assert rows(cp.resumable(df), "case_id", "refused") == [("a", None), ("b", "not_partial"), ("c", "spent")]


def test_values_past_38_digits_keep_their_digits(spark):
    for text, want in (("0x0", "0"), ("0x", None), ("", None), ("zz", None), ("0x" + "0" * 60 + "1f", "31"), ("f" * 31, str(16**31 - 1)), ("0x" + "f" * 64, None), (None, None)):
        got = spark.createDataFrame([(text,)], "h string").select(scalars.hex_to_decimal(F.col("h")).cast("string").alias("d")).first()["d"]
        assert got == want, (text, got)
    wide = spark.createDataFrame([("0x" + "f" * 64,), ("0x0a",)], "h string")
    assert rows(ledgers._with_digits(wide, F.col("h")), "_digits") == [("10",), (str(2**256 - 1),)]


def test_sweeps_compare_whole_numbers(spark):
    big = 10**18
    at = lambda tx, a, b, n, second: move(tx, a, b, n, f"2024-01-01 00:00:0{second}")
    w = facts.comparable_window(ledger(spark, at("r", "a", "x", big, 0), at("o", "x", "b", big + 1, 1)))
    assert detectors.sweep_pairs(w).count() == 0
    w = facts.comparable_window(ledger(spark, at("r", "a", "x", big, 0), at("o", "x", "b", big, 1)))
    assert rows(detectors.sweep_pairs(w), "in_amount", "out_amount") == [(Decimal(big), Decimal(big))]


def test_nodes_past_a_budget_are_frontier(spark):
    df = ledger(spark, *[move(f"t{k}", "root", f"n{k}", 10 - k) for k in range(6)])
    cases = spark.createDataFrame([("k", "c", "root", "forward")], "case_id string, chain string, root string, direction string")
    nodes, _ = cp.trace(cases, df, None, 1, max_nodes=3)
    got = {r["address"]: r["state"] for r in nodes.collect()}
    assert got == {"root": "expanded", "n0": "depth_horizon", "n1": "depth_horizon", "n2": "frontier", "n3": "frontier", "n4": "frontier", "n5": "frontier"}
    told = answers.coverage_counters(nodes).first()
    assert told["frontier"] == 4 and not told["complete"]


def test_codes_without_a_known_ledger_are_skipped(spark):
    one = lambda code, a: f"<sdnEntry><uid>1</uid><lastName>N</lastName><idList><id><idType>Digital Currency Address - {code}</idType><idNumber>{a}</idNumber></id></idList></sdnEntry>"
    evm, btc = "0x" + "a" * 40, "1" + "Q" * 30
    body = "<sdnList><Publish_Date>08/18/2024</Publish_Date>" + one("ETC", evm) + one("BCH", btc) + one("ARB", evm) + one("BSC", evm) + one("BTC", btc) + one("USDT", evm) + "</sdnList>"
    docs = spark.createDataFrame([("p", body)], "path string, content string")
    claims, _ = documents.sanctions(docs)
    got = rows(claims, "chain", "address")
    assert ("bitcoin", btc) in got and len(got) == 2 and {a for _, a in got} == {btc, evm}
    assert rows(documents.skipped_codes(docs), "ticker", "n") == [("ARB", 1), ("BCH", 1), ("BSC", 1), ("ETC", 1)]


def test_reserve_networks_and_harmful_tags(spark):
    nets = ["ETH", "ETHEREUM", "BITCOIN", "TRON", "SOLANA", "POLYGON", "MATIC", "BSC"]
    docs = spark.createDataFrame([("p", "Network,Address,Message\n" + "\n".join(f"{n},a{k},m" for k, n in enumerate(nets)))], "path string, content string")
    claims, counts = documents.reserves(docs, "E", "s", "2024-01-01")
    assert rows(claims, "chain") == sorted((c,) for c in ["ethereum", "ethereum", "bitcoin", "tron", "solana", "polygon", "polygon"])
    assert counts.first()["unsupported"] == 1
    tags = spark.createDataFrame([("v", "Bybit Victim", 1), ("f", "Fake Bybit", 1), ("b", "Bybit 3", 1), ("d", "Bybit dep: 9", 1), ("s", "Some Settlement", 1)], "address string, tag string, n int")
    got = rows(documents.tag_claims(tags, spark.createDataFrame([("bybit", "Bybit"), ("bybit dep", "Bybit")], "prefix string, entity string")), "address", "category", "role")
    assert got == [("b", "vasp", "unknown"), ("d", "vasp", "deposit"), ("s", "infrastructure", "unknown")]


def sdn(body, root="sdnList", day="<publshInformation><Publish_Date>08/18/2024</Publish_Date></publshInformation>"):
    return f"<{root}>{day}{body}</{root}>"


def sdn_entry(*ids, name="Evil", attribute=""):
    rows = "".join(f"<id><idType>Digital Currency Address - {c}</idType><idNumber>{a}</idNumber></id>" for c, a in ids)
    return f"<sdnEntry{attribute}><lastName>{name}</lastName><akaList><aka><lastName>Alias</lastName></aka></akaList><idList>{rows}</idList></sdnEntry>"


def test_sanctions_by_encoding_and_form(spark):
    evm, tron, btc, sol = "0x" + "aB" * 20, "T" + "z" * 33, "1" + "Q" * 30, "S" + "x" * 40
    shapes = sdn_entry(("USDT", sol), ("ETH", sol), ("XBT", tron), ("SOL", btc), ("USDC", evm), ("ETH", evm.lower()), ("ETC", evm)) + sdn_entry(("ETH", evm), name="Later") + sdn_entry(("XBT", btc), name=" ")
    prefixed = '<n:sdnList xmlns:n="urn:x"><n:Publish_Date>2024-08-18</n:Publish_Date><n:sdnEntry lang="en"><n:lastName>P &amp; Q</n:lastName><n:idList><n:id><n:idType>Digital Currency Address - ETH</n:idType><n:idNumber>' + evm + "</n:idNumber></n:id></n:idList></n:sdnEntry></n:sdnList>"
    good = sdn_entry(("ETH", evm), attribute=' lang="en"')
    docs = spark.createDataFrame(
        [("shapes", sdn(shapes)), ("prefixed", prefixed), ("attribute", sdn(good)), ("middle", sdn("<sdnEntry><uid>1</uix></sdnEntry>" + good)), ("amp", sdn(good.replace("Evil", "A & B"))), ("tail", sdn(good) + "<x>"), ("root", sdn(good, root="list")), ("silent", sdn(sdn_entry(("ETC", evm)))),
         ("day", sdn(good, day="<publshInformation><Publish_Date>today</Publish_Date></publshInformation>")), ("none", None), ("void", "")], "path string, content string",
    )
    claims, bad = documents.sanctions(docs)
    assert rows(claims.where("path = 'shapes'"), "chain", "address", "entity") == sorted([("ethereum", sol, "Evil"), ("tron", tron, "Evil (listed by OFAC as XBT; filed on tron from the address encoding)"), ("solana", btc, "Evil"), ("ethereum", evm.lower(), "Evil")])
    assert rows(claims.where("path <> 'shapes'"), "path", "entity") == [("attribute", "Evil"), ("prefixed", "P & Q")]
    assert rows(bad.withColumn("why", F.array_join("reasons", ",")), "path", "why") == sorted([("middle", "malformed"), ("amp", "malformed"), ("tail", "open"), ("root", "root"), ("silent", "empty"), ("day", "date"), ("none", "root"), ("void", "root")])
    assert rows(documents.skipped_codes(docs), "path", "ticker", "n") == [("shapes", "ETC", 1), ("shapes", "USDT", 1), ("silent", "ETC", 1)]
    assert documents.sanctions(docs.limit(0))[0].count() == 0


def test_reserve_cells_are_csv(spark):
    text = '\ufeffCoin,Balance\r\nBTC,1\r\nCoin, Message ,"Network",Address\r\nBTC,"hello, I own",ETH,0xab\r\nBTC,"he said ""a, b""\r\nand address, message",BTC," 1Q "\r\n\r\nBTC,it is 5" long,TRX,T1\r\nshort\r\nBTC,"open,ETH,0xcd'
    claims, counts = documents.reserves(spark.createDataFrame([("p", text), ("n", None), ("h", "Address,Message")], "path string, content string"), "E", "s", "2024-01-01")
    assert rows(claims, "path", "chain", "address") == [("p", "bitcoin", "1Q"), ("p", "ethereum", "0xab"), ("p", "tron", "T1")]
    assert rows(counts, "path", "empty", "kept", "refused") == [("h", 0, 0, True), ("n", 0, 0, True), ("p", 2, 3, False)]


def test_contested_tags(spark):
    tags = [("a", "Binance 14", 1, None), ("a", "Binance Pool", 2, None), ("b", "Binance Poolside", 1, None), ("b", "Proxy", 2, None), ("c", "Fake Router", 1, None), ("d", None, 1, "dex"), ("e", "Binance dep: 3", 1, None), ("e", "OKX: DEX Router", 2, None), ("f", None, 1, None), ("g", "", 1, " aave ")]
    df = spark.createDataFrame(tags, "address string, tag string, n int, slug string")
    got = rows(documents.tag_claims(df, spark.createDataFrame([("binance", "Binance")], "prefix string, entity string")), "address", "entity", "category", "role")
    infra = lambda a, e: (a, e, "infrastructure", "unknown")
    assert got == [("a", "Binance", "vasp", "unknown"), infra("b", "Proxy"), infra("c", "Fake Router"), infra("d", "non-custodial contract"), infra("e", "OKX: DEX Router"), infra("g", "non-custodial contract")]


def test_resume_admits_cut_nodes_up_to_the_new_budget(spark):
    fan = [move(f"t{k}", f"n{k}", "root", 100 - k) for k in range(7)]
    df = ledger(spark, *fan, move("u", "deep", "n0", 5), move("v", "late", "n3", 5))
    cases = spark.createDataFrame([("c1", "c", "root", "backward")], "case_id string, chain string, root string, direction string")
    nodes, edges = cp.trace(cases, df, None, 1, max_nodes=3)
    assert rows(nodes.where("state = 'frontier'"), "address", "reason") == [(f"n{k}", "max_nodes") for k in range(2, 7)]
    more, all_edges = cp.resume(nodes, edges, df, max_depth=2, max_nodes=6)
    states = {r["address"]: r["state"] for r in more.collect()}
    assert states == {"root": "expanded", "n0": "expanded", "n1": "expanded", "n2": "expanded", "n3": "expanded", "n4": "expanded", "n5": "frontier", "n6": "frontier", "deep": "frontier", "late": "frontier"}
    assert rows(all_edges, "src", "dst") == sorted([("root", f"n{k}") for k in range(7)] + [("n0", "deep"), ("n3", "late")])
    last = {r["address"]: r["state"] for r in cp.resume(more, all_edges, df, max_depth=2, max_nodes=10)[0].collect()}
    assert set(last) == set(states) and "frontier" not in last.values()


def test_search_of_links_both_ways(spark):
    links = [("r", "a", "t1"), ("b", "a", "t2"), ("b", "c", "t3"), ("c", "w", "t4"), ("w", "x", "t5"), ("z", "r", "t6"), ("a", "a", "t7"), ("r", None, "t8"), ("b", "a", "t0"), ("q", "y", "t9"), ("b", "r", "u1")]
    df = spark.createDataFrame([("k", *x) for x in links] + [("m", "b", "a", "t2"), ("m", "r", "a", "t1")], "case_id string, payer string, payee string, tx_hash string")
    roots = spark.createDataFrame([("k", "r"), ("k", "r"), ("m", "r"), ("n", "lone"), ("o", None)], "case_id string, root string")
    walls = spark.createDataFrame([("k", "w"), ("m", "r")], "case_id string, address string")
    told = lambda f, case: {r["address"]: (r["hops"], r["level"], ",".join(r["path"])) for r in f.where(F.col("case_id") == case).collect()}
    found = paths.linked_search(df, roots, walls)
    assert told(found, "k") == {"r": (0, 0, ""), "a": (1, 1, "t1"), "b": (1, -1, "u1"), "z": (1, -1, "t6"), "c": (2, 0, "u1,t3"), "w": (3, 1, "u1,t3,t4")}
    assert told(found, "m") == {"r": (0, 0, ""), "a": (1, 1, "t1"), "b": (2, 0, "t1,t2")} and told(found, "n") == {"lone": (0, 0, "")}
    assert "x" in told(paths.linked_search(df, roots), "k") and "c" not in told(paths.linked_search(df, roots, max_levels=1), "k")
    nodes = spark.createDataFrame([("k", a) for a in "rabzcwy"], "case_id string, address string")
    assert rows(paths.drawing_levels(nodes, found), "address", "level", "place") == [("a", 1, 1), ("b", -1, 1), ("c", 0, 1), ("r", 0, 2), ("w", 1, 2), ("y", 0, 3), ("z", -1, 2)]
    assert paths.linked_search(df.limit(0), roots.limit(0)).count() == 0


def test_a_long_path_tells_its_first_transactions(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}", f"t{k:02}") for k in range(12)], "payer string, payee string, tx_hash string")
    last = paths.linked_search(chain, spark.createDataFrame([("k", "n0")], "case_id string, root string")).where("address = 'n12'").first()
    assert (last["hops"], last["level"], last["path"]) == (12, 12, [f"t{k:02}" for k in range(10)])


def test_machine_local_folders_are_for_local_masters():
    from trailspark import runtime

    assert [runtime.is_local(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "yarn", "spark://x:7077")] == [True, True, True, False, False, False]


def test_made_documents_do_not_grow_with_the_table(spark, tmp_path):
    for name in ("orders", "supplier", "nation"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.range(120_000).selectExpr("id AS c_custkey", "CAST(id % 25 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    for made in (queries_ingest.pack_documents, queries_ingest.reserve_tables):
        sizes = made(spark, str(tmp_path)).selectExpr("max(length(content)) AS most", "count(*) AS n").first()
        assert sizes["most"] < 150_000 and sizes["n"] > 25


def test_no_document_is_parsed_once_a_row(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([("p", "")], "path string, content string")
    packs = plan(documents.labelpacks(texts)[0])
    assert not any("from_json" in body.split(", lambda ")[0] for body in packs.split("lambdafunction(")[1:])
    tables = plan(documents.reserves(texts, "E", "s", "2024-01-01")[0])
    assert tables.index("Generate explode") < tables.index("AS names")


def test_pack_confidence_counts_with_its_default(spark):
    pack = lambda own, given: json.dumps({"source": "s", "method": "m", "source_date": "2024-01-01", **given, "labels": [{"chain": "c", "address": "a", **x} for x in own]})
    c = lambda x: {"confidence": x}
    given = {"default_confidence": 0.5}
    told = {"good": pack([c(0.2), {}], given), "no default": pack([c(0.2), {}], {}), "unused": pack([c(0.2)], {"default_confidence": 1.5}), "low": pack([c(0), {}], given), "high": pack([{}, c(1)], given), "bad default": pack([{}], {"default_confidence": 0}), "none": pack([], {})}
    claims, refused = documents.labelpacks(spark.createDataFrame(list(told.items()), "path string, content string"))
    assert rows(claims, "path", "confidence") == [("good", 0.2), ("good", 0.5), ("unused", 0.2)]
    assert sorted(r["path"] for r in refused.collect()) == ["bad default", "high", "low", "no default"]


def test_shuffles_start_with_more_partitions_for_more_rows(spark):
    key, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    for rows_, parts in ((10_000_000, "50"), (100_000_000, "500"), (600_000, None)):
        runtime.fit_partitions(spark, rows_)
        assert spark.conf.get(key, None) == parts
    assert spark.conf.get(size, None) == before


def test_tasks_are_bounded_where_the_session_has_partitions_enough(spark):
    key, size, parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before, own = spark.conf.get(parts), spark.conf.get(size, None)
    spark.conf.set(parts, "200")
    try:
        runtime.fit_partitions(spark, 36_000_000)  # 180 partitions would do
        assert (spark.conf.get(key, None), spark.conf.get(size)) == (None, str(runtime.TASK_BYTES))
        runtime.fit_partitions(spark, 600_000)
        assert spark.conf.get(size, None) == own
        spark.conf.set(size, "8m")  # smaller tasks of the session's own stay so
        for rows_ in (36_000_000, 360_000_000):
            runtime.fit_partitions(spark, rows_)
            assert spark.conf.get(size) == str(8 << 20)
        runtime.fit_partitions(spark, 600_000)
        assert spark.conf.get(size) == "8m"
    finally:
        spark.conf.set(parts, before)
        spark.conf.unset(size) if own is None else spark.conf.set(size, own)


def test_gas_stamp_runs_with_bounded_tasks_and_is_right(spark, tmp_path, monkeypatch):
    from trailspark.plans import registry

    monkeypatch.setattr(runtime, "FEW_ROWS", 5, raising=False)
    size, own = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    day = pd.Timestamp("2024-01-01").to_pydatetime()
    # order, line, tax, flag: native price first, then token, then internal; none of it that parses
    told = [(1, 1, 0.05, "R"), (1, 2, 0.03, "A"), (1, 3, 0.04, "A"), (2, 1, 0.05, "R"), (2, 2, 0.0, "A"), (2, 3, 0.06, "N"), (3, 1, 0.07, "R"), (4, 1, 0.0, "R")]
    spark.createDataFrame([(o, 2, 3, n, 2.0, 10.0 + n, tax, flag, "O", day) for o, n, tax, flag in told], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "O") for k in range(6)], "o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    try:
        got = registry.QUERIES["a7_gas_stamp"](spark, str(tmp_path))
        assert spark.conf.get(size) == str(runtime.TASK_BYTES)
        assert rows(got, "tx_hash", "amount", "gas_price") == [("0xab1", 1100, 3), ("0xab2", 1100, 6), ("0xab3", 1100, 7), ("0xab4", 1100, None)]
    finally:
        runtime.fit_partitions(spark, 0)
    assert spark.conf.get(size, None) == own


def test_nodes_alone_are_those_of_the_whole_trace(spark):
    rng = random.Random(8)
    df = ledger(spark, *[move(str(k), f"a{rng.randrange(60)}", f"a{rng.randrange(60)}", rng.randrange(1, 99)) for k in range(400)])
    cases = spark.createDataFrame([(f"k{k}", "c", f"a{k}", d) for k in range(6) for d in ("backward", "forward")], "case_id string, chain string, root string, direction string")
    closed = spark.createDataFrame([("c", "a20", "vasp"), ("c", "a1", "mixer")], "chain string, address string, reason string")
    whole, edges = cp.trace(cases, df, closed, 3, 8, 4)
    alone, none = cp.trace(cases, df, closed, 3, 8, 4, nodes_only=True)
    assert rows(alone, *map(F.col, whole.columns)) == rows(whole, *map(F.col, whole.columns)) and alone.where("dropped > 0").count()
    assert none.count() == 0 < edges.count()


def test_stored_movements_are_shuffled_once(spark, tmp_path):
    from trailspark.plans import views

    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([(1, 2, 3, k % 2, 1.0, 10.0 + k, 0.1, "N", "O", pd.Timestamp("2024-01-01").to_pydatetime()) for k in range(4)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(5)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        mv = views.movements(spark, str(tmp_path))
        # one for lines and one for orders, none for the first write
        assert mv._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 2
        assert rows(mv, "tx_hash", "idx", "amount", "from_addr") == [("T1", 0, Decimal(1000), "A1"), ("T1", 1, Decimal(1100), "A1")]
    finally:
        spark.conf.set(key, before)


def test_a_second_value_is_summed_beside_the_first(spark):
    df = ledger(spark, move("1", "a", "root", 10, asset="X", verified=False), move("2", "b", "root", 7), move("3", "b", "root", 1, verified=False))
    got = cp.counterparties(df, "backward", more=[F.try_sum("amount").alias("all_value")])
    assert rows(got, "counterparty", "value", "all_value", "largest_tx", "largest_amount") == [("a", Decimal(0), Decimal(10), "1", "10"), ("b", Decimal(7), Decimal(8), "2", "7")]


def test_mixer_activity_shuffles_no_movement_to_meet_few_mixers(spark):
    from trailspark.operators import mixers

    df = ledger(spark, move("1", "a", "mix", 10), move("2", "mix", "b", 7), move("3", "mix", "mix2", 5), move("4", "a", "b", 3))
    few = spark.createDataFrame([("c", "mix"), ("c", "mix2"), ("c", "mix")], "chain string, address string")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        got = mixers.activity(df, few)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got, "mixer", "party", "side") == [("mix", "a", "deposit"), ("mix", "b", "withdrawal")]
    finally:
        spark.conf.set(key, before)


def test_edges_of_components_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def told(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 8)], "src long, dst long").repartition(1).select(F.udf(told, "long")("src").alias("src"), "dst")
    assert rows(connected_components(edges), "node", "component") == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7)]
    assert made.value <= 8  # a filter may read the column once more, the job runs once


def test_movements_are_made_once_a_query(spark, monkeypatch):
    from trailspark.plans import queries_facts, queries_rules

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    asked, real = [], queries_facts.movements
    for module in (queries_facts, queries_rules):
        monkeypatch.setattr(module, "movements", lambda *a: asked.append(1) or real(*a))
    queries_rules.stamped(spark, d)
    assert len(asked) == 1
