"""Shards resized by minimum-cost flow: the fewest bytes move, and only files that lose or gain rows are written.

Old shards and new shards with capacities are two sides of a network: a byte that stays in its
shard costs nothing, one that moves costs one, and successive shortest paths find the flow of least
cost. The network is bounded by old x new shards. A shard's flow cuts its bytes, in the order of its
files, into pieces; sums over files and over blocks of a file tell which piece a block lies in.
Blocks inside one piece go whole. In the few blocks that a cut meets, rows go one by one, from large
to small, to the piece that still lacks most, so shards miss their capacities by little.

Files all of whose rows stay are kept as they are; the others are rewritten under new shards.

Defined cases: a null text has size 1 and the checksum of nothing; null and repeated ids, repeated
rows and empty tables are rows like others (places in files tell them apart); other columns are
kept, but ``shard``, ``size``, ``old_shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import materialize, new_path, sized_broadcast

#: Rows of a block of a file.
BLOCK_ROWS = 4096
#: Blocks whose places are broadcast at most.
BROADCAST_BLOCKS = 100_000


def unit_cost(old: int, new: int) -> int:
    """What a byte costs: 1 to move, 0 to stay."""
    return int(old != new)


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost: Callable[[int, int], int] = unit_cost) -> dict[tuple[int, int], int]:
    """Bytes by (old shard, new shard) of least total cost; all of ``supply`` within ``capacity``.

    Successive shortest paths: as long as something is left to place, the cheapest path of the
    residual network (back along flows that are undone) takes as much as it can.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("capacities hold less than there is")
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = dict(supply), dict(capacity)
    while any(left.values()):
        # distances from all old shards with something left; nodes are ("o", i) and ("n", j)
        dist = {("o", i): 0 for i, x in left.items() if x}
        before: dict = {}
        changed = True
        while changed:
            changed = False
            for i in supply:
                for j in capacity:
                    c = cost(i, j)
                    for a, b, w in ((("o", i), ("n", j), c), (("n", j), ("o", i), -c)):
                        if a in dist and (a[0] == "o" or flow[i, j]) and dist[a] + w < dist.get(b, 1 << 62):
                            dist[b], before[b], changed = dist[a] + w, a, True
        j = min((x for x in capacity if room[x] and ("n", x) in dist), key=lambda x: (dist["n", x], x))
        path, at = [], ("n", j)
        while at in before:
            path.append((before[at], at))
            at = before[at]
        most = min([room[j], left[at[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "n")])
        for a, b in path:
            if a[0] == "o":
                flow[a[1], b[1]] += most
            else:
                flow[b[1], a[1]] -= most
        left[at[1]] -= most
        room[j] -= most
    return {k: x for k, x in sorted(flow.items()) if x}


def even_capacities(total: int, shards: int) -> dict[int, int]:
    """``total`` in equal parts, the first ones larger by one."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def write_layout(df: DataFrame, old: Column, size: Column, id_col: str) -> tuple[str, StructType]:
    """Store ``df`` by its old shards, as ``row`` (its columns), ``size`` and ``shard``; path and schema."""
    own = [c for c in df.columns if c not in ("shard", "size", "old_shard", "slot")]
    rows = df.select(F.struct(*own).alias("row"), size.cast("long").alias("size"), old.cast("int").alias("shard"), F.xxhash64(id_col).alias("spread"))
    return _write(rows, "shard", "layout"), rows.drop("spread").schema


def _write(rows: DataFrame, by: str, name: str) -> str:
    """Store rows by ``by``, in files of even numbers of rows by ranges of ``spread``."""
    path = new_path(rows.sparkSession, name)
    rows.repartitionByRange(by, "spread").drop("spread").write.partitionBy(by).parquet(path)
    return path


def _stored(spark: SparkSession, path: str, schema: StructType, files: list[str] | None = None) -> DataFrame:
    """Rows of a layout with ``file`` and ``at``, the row's place in it; of some files only, where told."""
    reader = spark.read.schema(schema).option("basePath", path)
    rows = reader.parquet(*([path] if files is None else files))
    return rows.withColumns({"file": F.col("_metadata.file_path"), "at": F.col("_metadata.row_index")})


def _before(rows: DataFrame, over: list[str], by: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those before in ``over``."""
    w = Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def pieces(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard) in bytes of the old shard: what stays comes first, then what goes, by new shard."""
    out = []
    for i in sorted({i for i, _ in flow}):
        parts = sorted((j != i, j, x) for (o, j), x in flow.items() if o == i)
        ends = list(accumulate(x for *_, x in parts))
        out += [(i, end - x, end, j) for (_, j, x), end in zip(parts, ends)]
    return out


def deal(sizes: list[int], wants: list[tuple[int, int]]) -> list[int]:
    """For each size a destination of ``wants`` (destination, bytes): large ones first, each to the one that lacks most."""
    heap = [(-x, dest) for dest, x in wants]
    heapq.heapify(heap)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        lack, dest = heap[0]
        out[k] = dest
        heapq.heapreplace(heap, (lack + sizes[k], dest))
    return out


def _destinations(spark: SparkSession, at: DataFrame, flow: dict[tuple[int, int], int]) -> tuple[DataFrame, DataFrame]:
    """Blocks (file, block, dest) that go whole, and rows (file, at, dest) of the blocks that are cut."""
    at = at.withColumn("block", F.floor(F.col("at") / BLOCK_ROWS))
    blocks = materialize(at.groupBy("shard", "file", "block").agg(F.sum("size").alias("bytes")), "blocks")
    files = _before(blocks.groupBy("shard", "file").agg(F.sum("bytes").alias("bytes")), ["shard"], "file", "bytes", "file_from")
    told = _before(blocks, ["shard", "file"], "block", "bytes", "block_from").join(files.select("shard", "file", "file_from"), ["shard", "file"])
    told = told.select("shard", "file", "block", (F.col("file_from") + F.col("block_from")).alias("low"), (F.col("file_from") + F.col("block_from") + F.col("bytes")).alias("high"))
    plan = spark.createDataFrame(pieces(flow), "shard int, begin long, end long, dest int")  # at most old + new shards rows a flow of least cost has
    met = told.join(F.broadcast(plan), "shard").where("low < end and begin < high")
    share = F.least("high", "end") - F.greatest("low", "begin")
    spots = materialize(met.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("dest", share.alias("bytes")))).alias("wants")), "places")
    whole = spots.where("size(wants) = 1").select("file", "block", F.col("wants")[0]["dest"].alias("dest"))
    cut = at.join(F.broadcast(spots.where("size(wants) > 1")), ["file", "block"])  # fewer blocks are cut than pieces are there

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        wants = [(w["dest"], w["bytes"]) for w in pdf["wants"].iloc[0]]
        return pd.DataFrame({"file": pdf["file"], "at": pdf["at"], "dest": deal(pdf["size"].tolist(), wants)})

    dealt = materialize(cut.groupBy("file", "block").applyInPandas(run, "file string, at long, dest int"), "dealt")
    return whole, dealt


def reshard(spark: SparkSession, path: str, schema: StructType, capacity: Callable[[int], dict[int, int]], cost: Callable[[int, int], int] = unit_cost) -> tuple[DataFrame, dict[str, int]]:
    """The layout at ``path`` in new shards, and what the plan moves and rewrites.

    ``capacity`` gives the new shards' capacities for a total. The result has the layout's columns,
    ``old_shard``, and ``slot``, the row's place in its shard, gapless from 0.
    """
    at = _stored(spark, path, schema).select("shard", "size", "file", "at")
    supply = {r["shard"]: r["bytes"] for r in at.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    if not supply:
        return _stored(spark, path, schema).select("row.*", "size", F.col("shard").alias("old_shard"), "shard", F.col("at").alias("slot")), {"moved_bytes": 0, "files_kept": 0, "files_rewritten": 0}
    flow = min_cost_flow(supply, capacity(sum(supply.values())), cost)
    whole, dealt = _destinations(spark, at, flow)
    goes = whole.select("file", "dest").unionByName(dealt.select("file", "dest")).distinct()
    home = at.select("file", "shard").distinct()
    told = goes.join(home, "file").groupBy("file").agg(F.max(F.col("dest") != F.col("shard")).alias("touched")).collect()
    touched, kept = ([r["file"] for r in told if r["touched"] is x] for x in (True, False))  # as many names as Spark's own listing of the files holds
    out = None
    if touched:
        rows = _stored(spark, path, schema, touched).withColumn("block", F.floor(F.col("at") / BLOCK_ROWS))
        one = whole.withColumnRenamed("dest", "whole")
        rows = rows.join(sized_broadcast(one, one.count(), BROADCAST_BLOCKS), ["file", "block"], "left")
        rows = rows.join(sized_broadcast(dealt, dealt.count(), BROADCAST_BLOCKS), ["file", "at"], "left")
        new = rows.select("row", "size", F.col("shard").alias("old_shard"), F.coalesce("whole", "dest").alias("shard"), F.xxhash64("file", "at").alias("spread"))
        fresh = _write(new, "shard", "resharded")
        out = _stored(spark, fresh, StructType([*schema.fields]).add("old_shard", "integer"))
    if kept:
        old = _stored(spark, path, schema, kept).withColumn("old_shard", F.col("shard"))
        out = old if out is None else out.unionByName(old, allowMissingColumns=True)
    files = out.groupBy("shard", "file").agg(F.count("*").alias("held"))
    base = _before(files, ["shard"], "file", "held", "base").select("file", "base")
    slots = out.join(sized_broadcast(base, len(told) + len(flow), BROADCAST_BLOCKS), "file").withColumn("slot", F.col("base") + F.col("at"))
    moved = sum(x for (i, j), x in flow.items() if i != j)
    return slots.select("row.*", "size", "old_shard", "shard", "slot"), {"moved_bytes": moved, "files_kept": len(kept), "files_rewritten": len(touched)}
