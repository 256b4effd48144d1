"""Secrets: fixed patterns, and a battery of randomness tests over long tokens.

Candidates are long runs of letters and digits with signs of base encodings; ``=`` belongs to one
only as padding at its end, so in ``name=value`` the value is tested by itself. A run that mixes
``+`` or ``/`` with ``-`` or ``_`` fits no encoding: it is cut at the one pair of signs and at the
other, and the parts of both cuts are candidates, which may overlap. Each candidate is read as the
smallest encoding that holds it (hex, base32, base64 and the like); a chi-squared test for
uniform use of that alphabet, a runs test about the median and a serial-correlation test give
p-values, combined by the harmonic mean. Over the whole table, within classes of length, the
Benjamini-Hochberg rule at RATE rejects tokens as not random; the false-discovery control is
length-aware because a class compares tokens whose tests have like power. What it does not
reject, and is long enough for its tests to have power, is a secret of kind ``random``.

Defined cases: null text counts as empty; null or repeated ids give a row each; a table without
rows gives none; texts of any length are read whole; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .bpe import _arrow_type

#: Base kinds in the order in which equal starts are listed, then the added kind.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Runs that are shorter would be dropped, and a match is always a whole run: the bound is part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Candidates: length, characters; they need a digit and a letter. A run is cut at each ``=`` that is not at its end.
LEAST_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_TOKEN)
PART = re.compile(r"[^=]+(?:=+\Z)?")
#: What a run is cut at when it holds signs of both pairs.
CUTS = (re.compile("[^+/]+"), re.compile("[^_-]+"))
#: False-discovery rate at which tokens are rejected as not random; steps of the p-value histogram a
#: power of ten, down to the smallest p-value.
RATE, STEPS, LEAST_P = 0.05, 100, 1e-12
#: Longer tokens are tested on all their characters but share the last class.
CLASSES = (20, 28, 40, 64, 128)
#: Entropy in bits a secret of kind random has at least, at the size of its alphabet.
LEAST_BITS = 80
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in _ALPHABETS]


def _normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[str, float] | None:
    """(encoding, combined p-value) of a token; None when no encoding holds it."""
    bare = token.rstrip("=")
    chars = set(bare)
    for name, letters, rank in _SETS:
        if chars <= letters:
            break
    else:
        return None
    x = np.array([rank[c] for c in bare])
    n, k = len(x), len(rank)
    if n < 8:
        return None
    # chi-squared with few expected counts: its mean and variance under uniform draws are exact
    chi = k / n * float((np.bincount(x, minlength=k) ** 2).sum()) - n
    sd = math.sqrt(2 * (k - 1) * (n - 1) / n)
    p = [min(1.0, 0.5 * math.erfc((chi - (k - 1)) / sd / math.sqrt(2)) * 2)]
    high = x >= k / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    c = x - (k - 1) / 2
    scale = float((c * c).sum())
    p.append(_normal_tail(float((c[1:] * c[:-1]).sum()) / scale * math.sqrt(n)) if scale else 0.0)
    p = [max(v, LEAST_P) for v in p]
    return name, min(1.0, len(p) / sum(1 / v for v in p))


def _candidate(t: str, at: int, taken: tuple[list[int], list[int]]) -> tuple[int, int, float, int] | None:
    """(start, end, p, class) of a candidate outside the spans taken (disjoint: starts, ends); None when it has too little."""
    if len(t) < LEAST_TOKEN or not re.search("[0-9]", t) or not re.search("[A-Za-z]", t):
        return None
    k = bisect_right(taken[1], at)
    if k < len(taken[0]) and taken[0][k] < at + len(t):
        return None
    got = battery(t)
    if got is None:
        return None
    bits = len(t.rstrip("=")) * math.log2(next(len(r) for n, _, r in _SETS if n == got[0]))
    return (at, at + len(t), got[1], sum(len(t) >= c for c in CLASSES)) if bits >= LEAST_BITS else None


def _tested(t: str, at: int, taken: tuple[list[int], list[int]]) -> list[tuple[int, int, float, int]]:
    """Candidates of a run without inner ``=``: itself, or its parts when no alphabet holds it."""
    if all(cut.search(t) and cut.sub("", t) for cut in CUTS):
        parts = [_candidate(m[0], at + m.start(), taken) for cut in CUTS for m in cut.finditer(t)]
    else:
        parts = [_candidate(t, at, taken)]
    return sorted({p for p in parts if p})


def _spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float, int]]]:
    """Base spans (start, kind, end) and candidates (start, end, p, class) outside them."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts: list[int] = []
    ends: list[int] = []
    for a, _, e in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(a)
            ends.append(e)
    more = []
    for m in TOKEN.finditer(text):
        for part in PART.finditer(m[0]):
            more += _tested(part[0], m.start() + part.start(), (starts, ends))
    return base, more


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<struct<start, rank, end>>, more array<struct<start, end, p, class>>) of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = _arrow_type(df, id_col)
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    more_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("class", pa.int32())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for t in b.column(1):
                x, y = _spans(t.as_py() or "")
                base.append([dict(zip(("start", "rank", "end"), v)) for v in x])
                more.append([dict(zip(("start", "end", "p", "class"), v)) for v in y])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(base, base_type), pa.array(more, more_type)], names=[id_col, "base", "more"])

    schema = f"`{id_col}` {kind}, base array<struct<start:int,rank:int,`end`:int>>, more array<struct<start:int,`end`:int,p:double,class:int>>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def thresholds(found: DataFrame, rate: float = RATE) -> dict[int, float]:
    """By class of length, the p-value up to which tokens are rejected as not random.

    Benjamini-Hochberg over a histogram with steps of equal ratio: at most 12 * STEPS + 1 counts a
    class reach the driver.
    """
    last = round(-math.log10(LEAST_P) * STEPS)
    step = F.least(F.greatest(F.floor(-F.log10("t.p") * STEPS), F.lit(0)), F.lit(last)).cast("int")
    rows = found.select(F.explode("more").alias("t")).groupBy(F.col("t.class").alias("class"), step.alias("step")).count().collect()
    out = {}
    # the largest p of a step, and a little for rounding
    limit = np.minimum(10.0 ** (-np.arange(last, -1, -1) / STEPS) * (1 + 1e-9), 1.0)
    for c in {r["class"] for r in rows}:
        bins = np.zeros(last + 1, dtype=np.int64)
        for r in rows:
            if r["class"] == c:
                bins[last - r["step"]] += r["count"]
        upto = np.cumsum(bins)
        ok = np.flatnonzero(limit * upto[-1] <= rate * upto)
        out[c] = float(limit[ok[-1]]) if len(ok) else 0.0
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, rank, kind, end>>) of every row: base kinds and ``random``."""
    found = materialize(scan(df, id_col, text_col), "secrets")
    limits = thresholds_map(found)
    names = F.array(*map(F.lit, KINDS))
    span = lambda start, rank, end: F.struct(start.alias("start"), rank.alias("rank"), F.get(names, rank).alias("kind"), end.alias("end"))
    base = F.transform("base", lambda s: span(s["start"], s["rank"], s["end"]))
    kept = F.filter("more", lambda s: s["p"] > limits(s["class"]))
    more = F.transform(kept, lambda s: span(s["start"], F.lit(3), s["end"]))
    return found.select(id_col, F.array_sort(F.concat(base, more)).alias("spans"))


def thresholds_map(found: DataFrame):
    """The thresholds as a function of a class column."""
    by_class = sorted(thresholds(found).items())

    def of(c: Column) -> Column:
        out = F.lit(0.0)
        for k, p in by_class:
            out = F.when(c == k, p).otherwise(out)
        return out

    return of
