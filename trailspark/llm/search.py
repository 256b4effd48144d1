"""Ranked lexical search for many queries at once, with shared partial scores.

Queries of one set share terms. Their terms are put in one order (most queries first), and pairs of
neighbours that two or more queries hold become nodes of their own, again and again: shared term
sets, each the union of two smaller ones, form a DAG whose roots a query adds up. Documents are
read in blocks: a block's term scores are computed once, the accumulators of shared sets once from
those below them, and every query's scores from its few roots. A task keeps each query's best
documents, so what is shuffled is queries x k rows a task.

Queries are taken in blocks of bounded size (BLOCK_TERMS), each a pass over the documents; what goes
to tasks (terms, weights, DAG) is bounded by that. Document statistics are of all documents.

Defined cases: null and empty texts have no terms, rank nowhere and do not count; an item without
terms has no rows; rows that share an item id are one item; a null item id is an item of its own; a
null document id ranks after others of its score; repeated rows are documents each; fewer than k
rows come where fewer documents score; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Item and term pairs that a block of items has on average at most.
BLOCK_TERMS = 200_000
#: Accumulator cells of a block of documents.
BLOCK_CELLS = 1 << 22

#: What is no part of a term is a blank, A-Z are a-z; bytes over 127 belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: maximal stretches of letters, digits and characters beyond ASCII; A-Z folded."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


@dataclass(frozen=True)
class Sharing:
    """Nodes 0 to leaves - 1 are terms; node leaves + j adds left[j] and right[j], which come before it; roots by item."""

    leaves: int
    left: np.ndarray
    right: np.ndarray
    ends: list[int]  # nodes up to which a level reaches, by level
    roots: list[list[int]]


def share(items: list[list[int]], leaves: int) -> Sharing:
    """The term sets that items share, as a DAG; each inner node is used by two or more items or nodes."""
    support = Counter(t for item in items for t in item)
    rows = [sorted(item, key=lambda t: (-support[t], t)) for item in items]
    left, right, ends = [], [], []
    while True:
        seen = Counter(pair for row in rows for pair in zip(row, row[1:]))
        chosen = []
        for row in rows:  # neighbours that most items share first, none in two pairs
            taken, picks = set(), []
            for i in sorted(range(len(row) - 1), key=lambda i: (-seen[row[i], row[i + 1]], i)):
                if seen[row[i], row[i + 1]] < 2:
                    break
                if i not in taken and i + 1 not in taken:
                    taken |= {i, i + 1}
                    picks.append(i)
            chosen.append(picks)
        used = Counter((row[i], row[i + 1]) for row, picks in zip(rows, chosen) for i in picks)
        fresh = {pair: leaves + len(left) + k for k, pair in enumerate(sorted(p for p, n in used.items() if n >= 2))}
        if not fresh:
            return Sharing(leaves, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), ends, rows)
        left += [a for a, _ in fresh]
        right += [b for _, b in fresh]
        ends.append(leaves + len(left))
        for row, picks in zip(rows, chosen):
            for i in sorted((i for i in picks if (row[i], row[i + 1]) in fresh), reverse=True):
                row[i : i + 2] = [fresh[row[i], row[i + 1]]]


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the terms of the vocabulary that a document holds, with all its terms counted in n."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, ids, tfs = [], [], []
                for t in part.column(1):
                    words = terms(t.as_py())
                    found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                    n.append(len(words))
                    ids.append([x for x, _ in found])
                    tfs.append([c for _, c in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best(score: np.ndarray, doc: np.ndarray, void: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item: highest score, smallest id, null ids last."""
    order = np.lexsort((doc, void, -score, item))
    item = item[order]
    first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.empty(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.concatenate((first, [len(item)]))))
    return order[rank < k]


def _ranked(counted: DataFrame, dag: Sharing, weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item, from accumulators along the DAG."""
    nodes = dag.leaves + len(dag.left)
    held = [i for i, r in enumerate(dag.roots) if r]
    flat = np.array([x for i in held for x in dag.roots[i]], dtype=np.int64)
    starts = np.cumsum([0, *(len(dag.roots[i]) for i in held)])[:-1]
    number = np.array(held, dtype=np.int64)
    block = max(16, BLOCK_CELLS // max(1, nodes + len(flat)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        best = (none, none, none.astype(bool), none)  # score, doc, whether its id is null, item's place
        floor = np.ones(len(held), dtype=np.int64)  # least score that may still enter
        for b in batches:
            for at in range(0, b.num_rows if len(held) else 0, block):
                part = b.slice(at, block)
                void = np.asarray(part.column(0).is_null())
                doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                sizes = np.asarray(part.column(2).value_lengths())
                where = np.repeat(np.arange(part.num_rows), sizes)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = np.array([10 + 90 * x * total // length for x in n.tolist()], dtype=np.int64)
                acc = np.zeros((nodes, part.num_rows), dtype=np.int64)
                acc[term, where] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[where]))
                begin = dag.leaves
                for end in dag.ends:  # a shared set is added up once, from sets below its level
                    some = slice(begin - dag.leaves, end - dag.leaves)
                    acc[begin:end] = acc[dag.left[some]] + acc[dag.right[some]]
                    begin = end
                score = np.add.reduceat(acc[flat], starts, axis=0)
                item, d = np.nonzero(score >= floor[:, None])
                cols = [np.concatenate(x) for x in zip(best, (score[item, d], doc[d], void[d], item))]
                keep = _best(*cols, k)
                best = tuple(c[keep] for c in cols)
                count = np.bincount(best[3], minlength=len(held))
                low = np.full(len(held), np.iinfo(np.int64).max)
                np.minimum.at(low, best[3], best[0])
                floor = np.where(count >= k, np.maximum(low, 1), 1)
        ids = pa.array(np.where(best[2], 0, best[1]), pa.int64(), mask=best[2])
        yield pa.RecordBatch.from_arrays([pa.array(number[best[3]]), ids, pa.array(best[0])], names=["item", "doc_id", "score"])

    return counted.select("doc_id", "n", "terms", "tfs").where("size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(terms(t.as_py()))) for t in b.column(1)], pa.list_(pa.binary()))], names=["item", "terms"])

    schema = f"item {items.schema['item'].dataType.simpleString()}, terms array<binary>"
    return items.mapInArrow(run, schema).select("item", F.explode("terms").alias("term")).distinct()


def rank_items(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank int, doc_id, score long): each item's ``k`` documents of highest score above 0, ties by smallest id."""
    spark = docs.sparkSession
    wanted = materialize(_item_terms(items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))), "items")
    blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.array_sort(F.collect_list("term")).alias("terms")).orderBy("item").collect()
        vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in rows for w in r["terms"]}))}
        dag = share([[vocabulary[bytes(w)] for w in r["terms"]] for r in rows], len(vocabulary))
        counted = materialize(_counted(texts, vocabulary), "counted")
        total, length = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], dtype=np.int64)
        found = _ranked(counted, dag, weight, total, max(1, length or 0), k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item long, name {wanted.schema['item'].dataType.simpleString()}")
        some = top.join(names, "item").select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), "score")
        out = some if out is None else out.unionByName(some)
    return out
