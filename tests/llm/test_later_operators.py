"""Resharding, ranked search and periodic runs: brute force on small fixtures and their queries on whole small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("trailspark.llm")

from pyspark.sql import functions as F  # noqa: E402

from trailspark.llm import queries, resharding, runs, search  # noqa: E402

DATA = "/root/testdata/sf0.001"
ODD = [(1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \t\n "), (5, "x x x x x x x"), (5, "x x x x x x x"), (None, "\x1c a b"), (8, "w " * 30_000), (9, "y" * 70_000)]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def documents(spark, rows=ODD):
    names = ("shard", "size", "old_shard", "slot", "file", "at", "block", "dest", "n", "terms", "item", "runs", "periodic", "words")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})


# ---------------------------------------------------------------- 11
def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(200):
        supply = {i: rng.randint(0, 40) for i in range(rng.randint(1, 4))}
        capacity = {j: rng.randint(0, 30) for j in range(rng.randint(1, 5))}
        need = sum(supply.values()) - sum(capacity.values())
        if need > 0:
            with pytest.raises(ValueError):
                resharding.min_cost_flow(supply, capacity)
            capacity[0] += need
        flow = resharding.min_cost_flow(supply, capacity)
        for i, x in supply.items():
            assert sum(f for (a, _), f in flow.items() if a == i) == x
        assert all(sum(f for (_, b), f in flow.items() if b == j) <= c for j, c in capacity.items())
        # each old shard keeps what its new capacity holds; no plan moves less
        assert sum(f for (a, b), f in flow.items() if a != b) == sum(max(0, x - capacity.get(i, 0)) for i, x in supply.items())


def test_flow_undoes_earlier_paths():
    cost = {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 9}
    assert resharding.min_cost_flow({0: 5, 1: 5}, {0: 5, 1: 5}, lambda i, j: cost[i, j]) == {(0, 1): 5, (1, 0): 5}


def reshard(spark, df, old, shards):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    path, schema = resharding.write_layout(df, old, size, "doc_id")
    return resharding.reshard(spark, path, schema, lambda total: resharding.even_capacities(total, shards))


def test_resharding_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 4)
    out, figures = reshard(spark, documents(spark), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)), 3)
    rows = out.collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in rows])) == sorted(map(repr, ODD))
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert figures["files_rewritten"] > 0
    empty, figures = reshard(spark, documents(spark).limit(0), F.lit(0), 3)
    assert empty.count() == 0 and figures["moved_bytes"] == 0


def test_resharding_leaves_what_stays(spark):
    rows = [(i, "z" * (i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out, figures = reshard(spark, df, F.when(F.col("doc_id") < 1990, F.lit(0)).otherwise(F.lit(1)), 1)
    assert out.count() == 2000 and out.where("shard <> 0").isEmpty()
    assert figures["files_kept"] >= 1 and figures["moved_bytes"] == sum(1 + len(t) for i, t in rows if i >= 1990)


@needs_data
def test_resharding_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_resharding(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    sizes = Counter()
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and max(abs(x - mean) for x in sizes.values()) < 0.02 * mean
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


# ---------------------------------------------------------------- 12
def test_shared_sets_add_up_to_every_item():
    rng = random.Random(4)
    for _ in range(60):
        items = [rng.sample(range(30), rng.randint(0, 12)) for _ in range(rng.randint(0, 15))] + [list(range(8))] * 3
        dag = search.share(items, 30)
        held = [{i} for i in range(30)]
        for a, b in zip(dag.left.tolist(), dag.right.tolist()):
            assert not held[a] & held[b]
            held.append(held[a] | held[b])
        for item, roots in zip(items, dag.roots):
            assert sum(len(held[r]) for r in roots) == len(item) and set().union(*(held[r] for r in roots)) == set(item)
        assert len(dag.roots[-1]) < 8  # three equal items share sets
        uses = Counter([*dag.left.tolist(), *dag.right.tolist(), *(r for roots in dag.roots for r in roots)])
        assert all(uses[30 + j] >= 1 for j in range(len(dag.left)))


def brute_ranks(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    total, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            n = sum(b.values())
            if n:
                m = 100 - 90 + (90 * n * total) // length
                s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(split(text)) if b[t])
                if s > 0:
                    found.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "Don't", "中文", "x_y", "42"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(None, "w1 w2"), (7, None), (9, ""), (9, "w1 w2"), (400, "w3 " * 5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(31, None), (32, "W1 w2 w3"), (33, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "tfs", "item", "rank", "score", "term")}).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    want = sorted(map(repr, brute_ranks(docs, items)))
    told = lambda out: sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in out.collect())
    assert told(search.rank_items(df, it)) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    monkeypatch.setattr(search, "BLOCK_CELLS", 200)
    assert told(search.rank_items(df, it)) == want
    assert search.rank_items(df.limit(0), it).count() == 0 and search.rank_items(df, it.limit(0)).count() == 0


# ---------------------------------------------------------------- 13
def brute_runs(w, least=6, repeats=4):
    out = {}
    for q in range(1, len(w) // repeats + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def test_squares_merge_into_all_runs(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        monkeypatch.setattr(runs, "PORTION", rng.choice([3, 17, 1000]))
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.7:
                base, at = [rng.randrange(3) for _ in range(rng.randint(1, 9))], rng.randint(0, len(w))
                w[at:at] = (base * 12)[: rng.randint(1, len(base) * 8)]
            texts.append(np.array(w, dtype=np.int64))
        for repeats in (2, 4):
            assert runs.find_runs(texts, 6, repeats) == [brute_runs(t.tolist(), 6, repeats) for t in texts]
    assert runs.find_runs([]) == []


def test_runs_defined_cases(spark):
    out = runs.periodic_runs(documents(spark).drop("periodic"))
    told = {(r["doc_id"], r["text"]): r["periodic"] for r in out.collect()}
    assert out.count() == len(ODD) and "words" in out.columns
    assert [tuple(x) for x in told[1, ODD[0][1]]["runs"]] == [(0, 8, 2)] and told[1, ODD[0][1]]["collapsed"] == "a b c"
    assert told[2, None]["runs"] == [] and told[4, ODD[3][1]]["collapsed"] == ""
    assert [tuple(x) for x in told[8, ODD[7][1]]["runs"]] == [(0, 30_000, 1)] and told[8, ODD[7][1]]["collapsed"] == "w"
    assert told[None, ODD[6][1]]["collapsed"] == "\x1c a b"
    assert runs.periodic_runs(documents(spark).limit(0)).count() == 0


@needs_data
def test_runs_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", docs[r["doc_id"]].encode())
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if n > 1500:
            continue  # the rule takes n * n steps
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        dropped = {i for s, m, q in found for i in range(s + q, s + m)}
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest()
