"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of each whole text are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Ridge weights solve normal equations that tasks sum over their
rows; sums of many tasks meet in SLOTS groups before a bounded number reaches the driver. Rows
set aside then give an isotonic map from ridge score to probability, from a histogram.

Defined cases: null or empty text has all statistics 0 and is scored like any text; labels that
are null are no labels, several labels of an id count as their mean; without labels, or with
one class only, every score is that class's share (0.5 without any); rows are scored one by
one, so repeated rows and null ids need nothing special; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import crc32_of_id, materialize

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "letters", "digits", "signs", "capitals", "signed_words",
    "commonest_word", "repeats_next", "distinct_lines", "line_words", "capital_words", "bars", "distinct_pairs",
)
FEATURES, RIDGE, SEED = 256, 1e-3, 17
#: Groups in which the sums of tasks meet: so many matrices of (FEATURES + 1)^2 doubles reach the driver at most.
SLOTS = 16
#: Steps of the score histogram for the isotonic map.
STEPS = 1000
THRESHOLD = 0.3
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 space, 5 bar
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[ord("|")] = 5
_CLASS[128:] = 1


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one whole text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=6)
    shown = max(1, len(raw) - int(kinds[4]))
    n, tally = len(words), Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words, words[1:]))
    signed = sum(1 for w in words if not w[-2:].isalnum() and len(w) > 2 and not w[-2].isalnum())
    return [
        math.log1p(len(text)), math.log1p(n), min(30.0, shown / n), len(tally) / n, (kinds[1] + kinds[2]) / shown, kinds[3] / shown,
        (kinds[0] + kinds[5]) / shown, kinds[2] / shown, signed / n, tally.most_common(1)[0][1] / n, same / n, len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))), sum(map(str.isupper, words)) / n, kinds[5] / shown, len(pairs) / max(1, n - 1),
    ]


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats array<double>), stored: texts are read once for training and scoring."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return materialize(df.select(F.col(id_col).alias("id"), stats(F.col(text_col).cast("string")).alias("stats")), "statistics")


@dataclass
class Model:
    """Means and spreads, random frequencies and phases, ridge weights, knots of the isotonic map."""

    mean: np.ndarray
    spread: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of statistics, with a constant."""
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.freq + self.phase
        return np.hstack((math.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores."""
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1."""
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least squares fit of ``y``, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # value, weight, members
    for v, m in zip(y.tolist(), w.tolist()):
        blocks.append([v, m, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, m2, c2 = blocks.pop()
            v1, m1, c1 = blocks.pop()
            blocks.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, c1 + c2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _constant(share: float, d: int) -> Model:
    zero = np.zeros(d)
    return Model(zero, np.ones(d), np.zeros((d, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([share, share]))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from every labelled row whose id's crc32 is not 0 modulo 5."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("mean"))
    rows = stats.join(told, "id").where(crc32_of_id("id") % 5 != 0)
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(13)), F.lit(5)) == 0
    rows = materialize(rows.select("stats", (F.col("mean") >= 0.5).cast("double").alias("y"), fold.alias("aside")), "training")
    d = len(STATISTICS)
    sums = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    whole = rows.agg(F.count("*").alias("n"), F.avg("y").alias("share"), *sums).first()
    if not whole["n"] or whole["share"] in (0.0, 1.0):
        return _constant(0.5 if not whole["n"] else whole["share"], d)
    rng = np.random.default_rng(SEED)
    mean = np.array([whole[f"m{i}"] for i in range(d)])
    spread = np.maximum(np.array([whole[f"s{i}"] for i in range(d)]), 1e-6)
    freq, phase = rng.normal(0, 1 / math.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES)
    model = Model(mean, spread, freq, phase, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    n = FEATURES + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros((n, n + 1))
        for pdf in frames:
            if len(pdf):
                z = model.fourier(np.vstack(pdf["stats"].to_numpy()))
                total += np.hstack((z.T @ z, (z.T @ pdf["y"].to_numpy())[:, None]))
        if total.any():
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % SLOTS], "sums": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["sums"]], axis=0)
        return pd.DataFrame({"slot": pdf["slot"][:1], "sums": [total.tobytes()]})

    kind = "slot int, sums binary"
    got = rows.where("not aside").mapInPandas(partial, kind).groupBy("slot").applyInPandas(add, kind).collect()
    if not got:
        return _constant(whole["share"], d)
    total = np.sum([np.frombuffer(r["sums"]) for r in sorted(got, key=lambda r: r["slot"])], axis=0).reshape(n, n + 1)
    count = total[-1, n - 1]
    model.weights = np.linalg.solve(total[:, :n] + RIDGE * count * np.eye(n), total[:, n])

    @F.pandas_udf("double")
    def ridge(s: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.vstack(s.to_numpy())) if len(s) else [], dtype=float)

    step = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), ridge("stats"))) * STEPS)
    bins = rows.where("aside").groupBy(step.alias("step")).agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    if not bins:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    model.knots = np.array([(b["step"] + 0.5) / STEPS for b in bins])
    model.values = isotonic(np.array([b["y"] for b in bins]), np.array([float(b["n"]) for b in bins]))
    return model


def scorer(model: Model):
    """Pandas UDF of a column of statistics: score from 0 to 1."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(s.to_numpy())) if len(s) else [], dtype=float)

    return score


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out boolean, score double, predicted int), a row for each input row."""
    stats = with_statistics(df, id_col, text_col)
    score = scorer(train(stats, labels, id_col))
    out = stats.select(F.col("id").alias(id_col), (crc32_of_id("id") % 5 == 0).alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
