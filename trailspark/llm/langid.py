"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (within words); a linear
softmax over it gives languages. Both are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows, then a temperature is fitted on rows of the sample
that were set aside, and a rejection threshold from the scores of their right answers.

Defined cases: null text or text without a letter gives ``und`` with score 0, rejected; a table
without labelled rows gives ``und`` everywhere; texts are counted whole, in blocks; rows are
scored one by one, so repeated rows and null ids need nothing special.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import crc32_of_id
from .memory import give_back

#: Buckets of the n-gram hash and length of an embedding.
BUCKETS, WIDTH = 4096, 16
#: Labelled rows that training uses at most, shared evenly by language.
SAMPLE_ROWS = 3000
#: Bytes of a text counted at a time.
BLOCK = 1 << 20
#: Share of right answers that rejection may cost, and the highest threshold it may set.
REJECT_SHARE, REJECT_MOST = 0.001, 0.5
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def _folding() -> np.ndarray:
    """Byte table: A-Z to a-z, other ASCII that is no letter to 0, bytes of longer characters as they are."""
    t = np.arange(256, dtype=np.uint32)
    t[:128] = 0
    for c in range(97, 123):
        t[c] = c
        t[c - 32] = c
    return t


_FOLD = _folding()


def counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of 1 to 4 bytes of a whole text; none spans two words."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    raw = text.encode("utf-8", "replace")
    for at in range(0, len(raw), BLOCK):
        b = _FOLD[np.frombuffer(raw[max(0, at - 3) : at + BLOCK], dtype=np.uint8)]
        fresh = min(at, 3)
        word = b != 0
        h, ok = np.zeros(len(b), dtype=np.uint32), np.ones(len(b), dtype=bool)
        for n in range(4):  # the n-gram that ends at each byte
            if n >= len(b):
                break
            h[n:] += (b[: len(b) - n] + np.uint32(n + 1)) * _MUL[n]
            ok[n:] &= word[: len(b) - n]
            ok[:n] = False
            use = h[fresh:][ok[fresh:]]
            use = (use ^ (use >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount(use >> np.uint32(20), minlength=BUCKETS)
    return out


def packed(c: np.ndarray) -> bytes:
    """Counts that are not 0: their places as 16-bit integers, then the counts as 32-bit ones."""
    at = np.flatnonzero(c)
    return at.astype("<u2").tobytes() + c[at].astype("<u4").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    """All counts, as 32-bit integers."""
    out, n = np.zeros(BUCKETS, dtype="<u4"), len(b) // 6
    out[np.frombuffer(b, dtype="<u2", count=n)] = np.frombuffer(b, dtype="<u4", offset=2 * n)
    return out


@dataclass
class Model:
    """Languages, class weights by bucket (embeddings times softmax), bias, temperature, threshold."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, c: np.ndarray) -> np.ndarray:
        """Calibrated probabilities for rows of counts."""
        total = np.maximum(c.sum(axis=1, keepdims=True), 1)
        z = ((c / total) @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def hash_bound(want: float, rows: int) -> int:
    """The signed 64-bit hash up to which about ``want`` of ``rows`` rows have theirs."""
    return min((1 << 63) - 1, int(want * (1 << 64) / max(rows, 1)) - (1 << 63))


def labelled_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, counts binary as of :func:`packed`, fold): about ``rows`` labelled rows, even over languages, by a hash of the id.

    Each language gives every row or a share of its rows; the share follows from its count and is
    a bound on a 64-bit hash, so the sample stays near its bound, and never empty, at any table size.
    """
    usable = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where(
        (crc32_of_id("id") % 5 != 0) & F.col("lang").isNotNull() & F.col("t").isNotNull()
    )
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not sizes:
        return usable.select("lang", F.lit(None).cast("binary").alias("counts"), F.lit(0).alias("fold"))
    each = rows / len(sizes)
    bound = F.lit(-(1 << 63))
    for r in sizes:
        bound = F.when(F.col("lang") == r["lang"], F.lit(hash_bound(each, r["count"]))).otherwise(bound)
    pick = F.xxhash64(F.col("id").cast("string"), F.lit(7)) <= bound

    def run(frames):
        for pdf in frames:
            c = [packed(counts(t)) for t in pdf["t"]]
            yield pd.DataFrame({"lang": pdf["lang"], "counts": c, "fold": pdf["fold"]})

    return usable.where(pick).select("lang", "t", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(5)).cast("int").alias("fold")).mapInPandas(run, "lang string, counts binary, fold int")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 30, seed: int = 5) -> Model | None:
    """A model from a bounded sample of the training rows (crc32 of the id not 0 modulo 5); None without labels."""
    got = [tuple(r) for r in labelled_sample(df, id_col, text_col, lang_col).collect()]
    if not got or all(c is None for _, c, _ in got):
        return None
    got.sort(key=lambda r: (r[0], r[2], unpacked(r[1]).tobytes()))
    langs = sorted({r[0] for r in got})
    aside = np.array([r[2] == 0 for r in got])
    if aside.all() or not aside.any():
        aside = np.zeros(len(got), dtype=bool)
    # rows that train come first, so that neither part of the table is copied; the driver holds it once
    got = [got[i] for i in np.argsort(aside, kind="stable")]
    n = len(got) - int(aside.sum())
    x = np.empty((len(got), BUCKETS), dtype=np.float32)
    for row, (_, c, _) in zip(x, got):
        row[:] = unpacked(c)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    y = np.array([langs.index(r[0]) for r in got])
    del got
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1 / np.sqrt(WIDTH), (BUCKETS, WIDTH)).astype(np.float32)
    w, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    # buckets of high frequency dominate an average, so steps are scaled by frequency
    scale = 1 / np.sqrt(x[:n].mean(axis=0) + 1e-5)
    held, truth = (x[n:], y[n:]) if n < len(x) else (x.copy(), y)
    xs, rows = x[:n], np.arange(n)
    xs *= scale
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.01
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
            v = xs[part] @ e / np.sqrt(WIDTH)
            z = v @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            down = p @ w.T / np.sqrt(WIDTH)
            w -= rate * (v.T @ p)
            bias -= rate * p.sum(axis=0)
            e -= rate * (xs[part].T @ down)
    weights = ((scale[:, None] * e) @ w / np.sqrt(WIDTH)).astype(np.float64)
    model = Model(langs, weights, bias.astype(np.float64), 1.0, 0.0)
    losses = []
    for t in np.geomspace(0.2, 8, 25):
        model.temperature = float(t)
        p = model.probabilities(held)[np.arange(len(truth)), truth]
        losses.append((-np.log(np.maximum(p, 1e-12)).mean(), float(t)))
    model.temperature = min(losses)[1]
    p = model.probabilities(held)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    model.threshold = float(min(REJECT_MOST, np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    del x, xs, held
    give_back()
    return model


def scorer(model: Model | None):
    """Pandas UDF of a text column: struct(lang_pred, score, accepted)."""

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if model is None or t is None or not any(map(str.isalpha, t)):
                out.append(("und", 0.0, False))
                continue
            p = model.probabilities(counts(t)[None, :])[0]
            k = int(p.argmax())
            out.append((model.langs[k], float(p[k]), bool(p[k] >= model.threshold)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    return score


def identify(df: DataFrame, model: Model | None, text_col: str = "text", to: str = "language") -> DataFrame:
    """``df`` with struct(lang_pred, score, accepted) of each whole text in column ``to``; a column of that name is replaced."""
    return df.withColumn(to, scorer(model)(F.col(text_col)))


def held_out(id_col: str | Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is 0 modulo 5."""
    return crc32_of_id(id_col) % 5 == 0
