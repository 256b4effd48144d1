"""Periodic runs of words, found by online dyadic square catching.

A square is a word sequence that occurs twice in a row; its half-length is its period q. Every
half of q words with ``2 B <= q < 4 B`` holds a whole block of B words that starts at a multiple
of B, and that block occurs again q words later. So each completed block of each power of two B
is a *catcher*: as words are appended, it meets the windows of B words that end with them and
begin 2 B to 4 B words after it. Windows are compared by dyadic names (the name of 2 B words is
a hash of the names of its halves). A catch starts a *suffix comparison* at distance q, which goes
back from the block as far as words agree and then forward with every appended word until two
disagree. A comparison that has agreed for q words is a square; its further agreement merges
all squares of that period into one run, which is reported when it ends. Comparisons are of word
ids, so a name that collides costs time and no result.

Words come in portions: a portion's windows are compared at once, and open comparisons go on
with the next portion. A stream takes many texts, each followed by a word that equals no other.

Defined cases: a null, empty or blank text has no words and no runs; texts of any length go
through whole; input rows are never merged or dropped; other columns pass through, and one named
like the output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a run, and least whole repeats.
LEAST_WORDS, LEAST_REPEATS = 6, 4
#: Words of a portion, and of a stream before it ends with the text at hand.
PORTION, STREAM_WORDS = 1 << 15, 1 << 18
#: Texts and bytes of an output batch.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class SquareStream:
    """Squares of a stream of word ids, merged into runs of ``repeats`` and more periods.

    ``longest`` bounds the words of one text, and so periods and catchers. A catch that lies inside
    a run of a period that divides its own is part of it and starts nothing.
    """

    def __init__(self, longest: int, repeats: int = LEAST_REPEATS):
        self.repeats = max(2, repeats)
        self.most = longest // self.repeats  # of a period
        self.words = np.empty(0, dtype=np.int64)
        self.names: list[np.ndarray] = []  # by level: names of the latest windows, by first word
        self.base: list[int] = []  # by level: first word of names[level][0]
        self.seen: list[int] = []  # by level: windows that have met their catchers
        self.open: dict[int, int] = {}  # period: number of its run
        self.reach = np.full(self.most + 2, -1, dtype=np.int64)  # by period: how far agreement is known
        self.runs = np.empty((64, 3), dtype=np.int64)  # start, end so far, period
        self.count = 0
        self.inner = np.empty(0, dtype=np.int64)  # by word: the run of smallest period that holds it, or -1
        self.outer = np.empty(0, dtype=np.int64)  # by word: the longest run that holds it, or -1

    def append(self, ids: np.ndarray) -> None:
        """Take the next words."""
        old = len(self.words)
        self.words = np.concatenate((self.words, ids))
        none = np.full(len(ids), -1, dtype=np.int64)
        self.inner, self.outer = np.concatenate((self.inner, none)), np.concatenate((self.outer, none))
        for q in list(self.open):
            self._forward(q, old)
        level, size = 0, 1
        while size <= max(1, self.most // 2):
            self._name(level, size)
            for q, start in self._caught(level, size):
                self._compare(q, start)
            level, size = level + 1, 2 * size
        for k in range(level):  # what no later window is compared with goes
            gone = max(0, len(self.words) - 6 * (1 << k) - self.base[k])
            if gone > 2 * PORTION:
                self.names[k], self.base[k] = self.names[k][gone:].copy(), self.base[k] + gone

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs (start, end, period) of the stream, which ends here, by start and period."""
        for q in list(self.open):
            self._close(q, len(self.words))
        least: dict[tuple[int, int], int] = {}  # a multiple of a period runs over the same words
        for a, b, q in self.runs[: self.count].tolist():
            if b - a >= self.repeats * q:
                least[a, b] = min(q, least.get((a, b), q))
        return sorted((a, b, q) for (a, b), q in least.items())

    def _name(self, level: int, size: int) -> None:
        """Names of the windows of ``size`` words that are complete by now."""
        if level == len(self.names):
            self.names.append(np.empty(0, dtype=np.uint64))
            self.base.append(0)
            self.seen.append(0)
        have, want = self.base[level] + len(self.names[level]), max(0, len(self.words) - size + 1)
        if want <= have:
            return
        if level == 0:
            new = _mix(self.words[have:want].astype(np.uint64) + np.uint64(1))
        else:
            half, below, at = size // 2, self.names[level - 1], self.base[level - 1]
            new = _mix(below[have - at : want - at] * np.uint64(0x9E3779B97F4A7C15) + (below[have + half - at : want + half - at] ^ np.uint64(level)))
        self.names[level] = np.concatenate((self.names[level], new))

    def _caught(self, level: int, size: int) -> list[tuple[int, int]]:
        """(period, block) of the fresh windows that equal a catcher and agree on one more side, by place.

        A square agrees for q words and its block has at most half of them, so half a block beside it agrees as well.
        """
        names, base, below = self.names[level], self.base[level], max(0, level - 1)
        places = np.arange(self.seen[level], base + len(names))
        self.seen[level] = base + len(names)
        if not len(places):
            return []
        latest = (places // size - 2) * size
        ways = [latest, latest - size] + ([places - 1] if size == 1 else [])
        half, beside = max(1, size // 2), self.names[below]
        out = []
        for blocks in ways:
            ok = (blocks >= 0) & (places - blocks <= self.most)
            p, s = places[ok], blocks[ok]
            ok = names[p - base] == names[s - base]
            p, s = p[ok], s[ok]
            q = p - s
            ok = p + size > self.reach[q]
            for held in (self.inner, self.outer):
                r = self.runs[held[s]] if self.count else np.full((len(s), 3), -1)
                ok &= (held[s] < 0) | (r[:, 0] > s) | (r[:, 1] < p + size) | (q % np.maximum(r[:, 2], 1) != 0)
            p, s, q = p[ok], s[ok], q[ok]
            back, on, last = np.maximum(s - half, 0) - self.base[below], s + size - self.base[below], len(beside) - 1
            agree = (on + q > last) | (q == 1)  # what is not known yet may agree
            agree |= (s >= half) & (beside[np.maximum(back, 0)] == beside[np.clip(back + q, 0, last)])
            agree |= beside[np.minimum(on, last)] == beside[np.minimum(on + q, last)]
            out += zip(q[agree].tolist(), s[agree].tolist())
        return sorted(out)

    def _compare(self, q: int, start: int) -> None:
        """Begin a suffix comparison at distance ``q`` from a caught block, unless one has covered it."""
        if start + q < self.reach[q]:
            return
        w, low, step = self.words, start, 16
        while low > 0:
            a = max(0, low - step)
            off = np.flatnonzero(w[a:low] != w[a + q : low + q])
            if len(off):
                low = a + int(off[-1]) + 1
                break
            low, step = a, 4 * step
        if self.count == len(self.runs):
            self.runs = np.concatenate((self.runs, np.empty_like(self.runs)))
        self.runs[self.count] = low, start + q, q
        self.open[q] = self.count
        self.count += 1
        self._forward(q, start + q)

    def _forward(self, q: int, at: int) -> None:
        """Go on comparing from word ``at`` with the words ``q`` before."""
        w, step, n = self.words, 16, len(self.words)
        while at < n:
            b = min(n, at + step)
            off = np.flatnonzero(w[at:b] != w[at - q : b - q])
            if len(off):
                return self._close(q, at + int(off[0]))
            at, step = b, 4 * step
        self._grow(self.open[q], n)

    def _close(self, q: int, end: int) -> None:
        self._grow(self.open.pop(q), end)

    def _grow(self, run: int, end: int) -> None:
        """The agreement of a run reaches to ``end`` by now; with two periods it holds squares, and its words are marked as its own."""
        start, was, q = self.runs[run].tolist()
        self.runs[run, 1] = self.reach[q] = end
        if end - start < 2 * q:
            if q not in self.open:  # no square: nothing to keep
                self.runs[run] = start, start, q
            return
        for held, better in ((self.inner, lambda r: r[:, 2] > q), (self.outer, lambda r: r[:, 1] - r[:, 0] < end - start)):
            span = held[start:end]
            mine = (span < 0) | better(self.runs[span])
            span[mine] = run


def find_runs(texts: list[np.ndarray], least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each of the texts (word ids from 0 on), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - np.array([len(t) + 1 for t in texts])
    between = -1 - np.arange(len(texts), dtype=np.int64)  # words that equal no other
    flat = np.concatenate([x for k, t in enumerate(texts) for x in (t, between[k : k + 1])])
    stream = SquareStream(max(map(len, texts)), repeats)
    for at in range(0, len(flat), PORTION):
        stream.append(flat[at : at + PORTION])
    for a, b, q in stream.finish():
        if b - a >= least:
            k = int(np.searchsorted(ends, a, side="right"))
            out[k].append((a - int(begins[k]), b - a, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)])


_TYPE = pa.struct([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_DDL = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _told(found: list[tuple[list[tuple[int, int, int]], bytes]]) -> pa.Array:
    rows = [{"runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": text.decode("utf-8")} for runs, text in found]
    return pa.array(rows, _TYPE)


def periodic_runs(df: DataFrame, text_col: str = "text", out_col: str = "periodic", least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> DataFrame:
    """``df`` with a struct column: ``runs`` array<struct<start, length, period>> by start and period, and ``collapsed`` text.

    Words are maximal stretches without blanks, tabs and line ends. A run is a stretch of at least ``least`` words and
    ``repeats`` periods, of smallest period, that no neighbour extends. ``collapsed`` keeps of each run its first period.
    """
    rest = [c for c in df.columns if c not in (text_col, out_col)]
    names = [*rest, text_col]
    schema = df.select(*names).schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        def flush(held, lines):
            runs = find_runs([ids for _, ids in held], least, repeats)
            out = _told([(r, collapse(words, r)) for (words, _), r in zip(held, runs)])
            rows = pa.concat_batches(lines) if len(lines) > 1 else lines[0]
            return pa.RecordBatch.from_arrays([*rows.columns, out], names=[*names, out_col])

        for b in batches:
            codes: dict[bytes, int] = {}
            held, lines, n, at, size = [], [], 0, 0, 0
            for k, t in enumerate(b.column(b.num_columns - 1)):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                words = raw.split()
                held.append((words, np.array([codes.setdefault(x, len(codes)) for x in words], dtype=np.int64)))
                n, size = n + len(words), size + len(raw)
                if n >= STREAM_WORDS or size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield flush(held, [b.slice(at, k + 1 - at)])
                    codes, held, n, at, size = {}, [], 0, k + 1, 0
            if held:
                yield flush(held, [b.slice(at, b.num_rows - at)])

    from pyspark.sql.types import StructType, _parse_datatype_string

    out_type = StructType(schema.fields).add(out_col, _parse_datatype_string(_DDL))
    return df.select(*names).mapInArrow(run, out_type).select(*[c for c in df.columns if c != out_col], out_col)


def best_run(runs):
    """The run of greatest exact length / period as a column: ties by smallest start, then period; null without runs."""
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, x: F.when(greater(x, best), x).otherwise(best)))
