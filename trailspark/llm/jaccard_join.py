"""Documents joined by the Jaccard similarity of their word shingles, with PartEnum signatures.

Sets of similar size share a band; a pair is looked for under the band of its larger set, so a
set signs its own band and the next. Two sets of a band with similarity of at least the
threshold differ in at most ``k`` features, which the band's largest size fixes. The feature
domain (64-bit hashes of shingles) is cut into ``n1`` ranges: some range holds at most ``k2``
of the differences. A range is cut into ``n2`` parts, and every subset of ``n2 - k2`` of them is
signed: one of these subsets holds no difference, so both sets sign it alike. Every linked pair
thus shares a signature; candidates are verified on the shingles of their whole texts.

Two refinements keep candidates few without losing a link:

- *Spare ranges.* ``n1`` exceeds what the count needs. A set of some size differs from its
  partners of a band in at most ``d`` features, so ``g = n1 - d / (k2 + 1)`` ranges at least are
  good; for a pair the larger of both counts holds. A set may leave unsigned up to
  ``(g - 1) / 2`` ranges of its own choice, and leaves those that hold fewest features: a
  signature of nothing would be shared with strangers.
- *Frequent features.* Shingles that FREQUENT or more documents hold, counted over all rows, are
  left out of the domain of the first family of signatures; differences in a part of the domain
  are at most all differences, so the count holds. A bucket of that family then has few members
  however large the table is. Sets with too little left for their spare ranges sign the whole
  domain as well, in a second family where they meet one another; to sets that sign fully they
  are joined in the first. Frequent shingles are known by a leading part of their hash; others
  that share it are left out too, which is as right. If more than MOST_FREQUENT are frequent,
  the most frequent are taken: buckets are larger then, and no link is lost.

A bucket (signature) of m documents yields m - 1 pairs with one of them, its leader: the one that
shares most over all buckets, so that the buckets of a family name the same pairs. A shard tells
buckets of two as pairs and larger ones by their members alone. Only documents of a bucket that
verified links leave in different components are compared with each other.
Before shingles are, sketches are: counts of features by range of the hash domain. The sum
of their differences is at most the number of differing features, so a pair that exceeds the
bound is no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import batch_bytes, materialize, release, sized_broadcast
from .memory import give_back

#: Words of a shingle; similarity in hundredths.
WORDS, PERCENT = 5, 80
#: In how many documents a shingle is frequent.
FREQUENT = 16
#: Most frequent shingles kept (8 bytes each).
MOST_FREQUENT = 1_000_000
#: Shingles and signatures by byte of text, roughly, and how many of either a reduce group holds on average.
BY_BYTE, SHARD_ITEMS = 0.15, 1_000_000
#: Bits that tell apart the shingles and the signatures of a shard.
CODE_BITS, KEY_BITS = 24, 32
#: Documents and shingles or signatures of a block, which a task sends together.
BLOCK_DOCS, BLOCK_ITEMS = 4096, 500_000
#: Shingles of a row, and pairs of one document that a group verifies on average.
PART_SHINGLES, GROUP_PAIRS = 1024, 256
#: Members of a bucket that a group compares at most, and sketch cells that it compares at a time.
BLOCK_MEMBERS, BLOCK_CELLS = 512, 1 << 22
#: Nearest pairs of two components in a bucket that a first round finds.
NEAREST = 64
#: Bytes of an Arrow batch of texts or sketches that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Candidate documents whose ids are broadcast at most.
BROADCAST_IDS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte; A-Z have those of a-z, white space has 0."""
    v = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    v[65:91] = v[97:123]
    v[[9, 10, 11, 12, 13, 32]] = 0
    return v


_BYTES = _byte_values()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    up, down = np.full(n, _ODD, dtype=np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit polynomial hashes of the words of UTF-8 bytes, ASCII case folded; cut at blanks, tabs and line ends."""
    size = 1 << 20
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > size:  # a block ends where a word does; a longer word has a block of its own
            cut = [p for p in (raw.find(c, at + size) for c in (b" ", b"\n", b"\t")) if p >= 0]
            end = min(cut) if cut else len(raw)
        v = _BYTES[np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)]
        up, down = _powers(1 << max(16, (end - at).bit_length()))
        word = (v != 0).view(np.int8)
        edges = np.flatnonzero(np.diff(word, prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)], dtype=np.uint64)))
        first, last = edges[:, 0], edges[:, 1]
        out.append(_mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; few words make one."""
    h = word_hashes((text or "").encode("utf-8", "replace"))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(len(h), words)), dtype=np.uint64)
    for k in range(min(words, len(h))):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k : k + n]
    return np.unique(_mix(out))


@dataclass(frozen=True)
class Band:
    """Sizes low to high, most differences k, ranges n1 of n2 parts with k2 spared."""

    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int

    def skip(self, size: int, percent: int) -> int:
        """Ranges that a set of ``size`` may leave unsigned in this band."""
        most = size * 100 // percent
        other = min(self.high, most) if size >= self.low else most
        differ = (size + other) * (100 - percent) // (100 + percent)
        return max(0, (self.n1 - differ // (self.k2 + 1) - 1) // 2)


def _band(low: int, percent: int) -> Band:
    high = max(low, low * 100 // percent)
    k = 2 * high * (100 - percent) // (100 + percent)
    if k <= 3:  # one range; subsets of its parts
        n1, n2, k2 = 1, (1, 4, 5, 6)[k], k
    elif k < 12:
        n1, n2, k2 = -(-(k + 1) // 3), 5, 2
    else:
        n1, n2, k2 = k // 2 + 1 + -(-k // 16), 3, 1
    return Band(low, high, k, n1, n2, k2)


@lru_cache(maxsize=4)
def bands(percent: int, most: int = 1 << 40) -> tuple[list[Band], np.ndarray]:
    """The bands that cover sizes 1 to ``most``, and their lowest sizes."""
    out, low = [], 1
    while low <= most:
        out.append(_band(low, percent))
        low = out[-1].high + 1
    return out, np.array([b.low for b in out])


@lru_cache(maxsize=512)
def _layout(n1: int, n2: int, k2: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of all parts in the hash domain, and the parts (0/1) of each subset."""
    n = n1 * n2
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    masks = np.ones((max(1, len(list(combinations(range(n2), k2)))), n2), dtype=np.uint64)
    for row, gone in enumerate(combinations(range(n2), k2)):
        masks[row, list(gone)] = 0
    return edges, masks


def _running(features: np.ndarray) -> np.ndarray:
    """Running sums of mixed features: differences of them are hashes of ranges."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(features), dtype=np.uint64)))


def _sign(features: np.ndarray, total: np.ndarray, band: Band, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n1, subsets) of sorted features for a band, and how many features each covers."""
    edges, masks = _layout(band.n1, band.n2, band.k2)
    cut = np.concatenate(([0], np.searchsorted(features, edges), [len(features)]))
    part = (total[cut[1:]] - total[cut[:-1]]).reshape(band.n1, band.n2)
    size = np.diff(cut).reshape(band.n1, band.n2)
    if band.n2 > 1:
        sums, covers = part @ masks.T, size @ masks.T.astype(np.int64)
    else:
        sums, covers = part, size
    place = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape)
    return _mix(_mix(sums ^ np.uint64(salt)) + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), covers


def _kept(sig: np.ndarray, covers: np.ndarray, skip: int, partial: bool) -> tuple[np.ndarray, bool]:
    """Signatures that a set gives, and whether its spare ranges cover all its empty signatures.

    Ranges with the least features go first; of a skipped range only signatures of fewer than
    three features go. If the empty ones reach further than the spare ranges, ``partial`` says
    that they are left out all the same (the set then signs elsewhere as well).
    """
    least = covers.min(axis=1)
    empty = int((least == 0).sum())
    if empty > skip:
        return (sig[covers > 0] if partial else sig.ravel()), False
    drop = np.zeros(covers.shape, dtype=bool)
    gone = np.argsort(least, kind="stable")[:skip]
    drop[gone] = covers[gone] < 3
    return sig[~drop], True


def signatures(features: np.ndarray, frequent: np.ndarray, percent: int = PERCENT, shift: int = 0) -> np.ndarray:
    """All signatures of a set of sorted features: its band and the next, one or both families.

    ``frequent`` holds sorted codes: frequent features without their last ``shift`` bits.
    """
    table, lows = bands(percent)
    at = int(np.searchsorted(lows, len(features), side="right")) - 1
    rare = features
    if len(frequent):
        codes = features >> np.uint64(shift)
        spot = np.searchsorted(frequent, codes)
        rare = features[frequent[np.minimum(spot, len(frequent) - 1)] != codes]
    out, total, whole = [], _running(rare), None
    for tag in (at, at + 1):
        band = table[tag]
        skip = band.skip(len(features), percent)
        part, full = _kept(*_sign(rare, total, band, 2 * tag), skip, True)
        out.append(part)
        if not full:
            whole = _running(features) if whole is None else whole
            out.append(_kept(*_sign(features, whole, band, 2 * tag + 1), skip, False)[0])
    return np.concatenate(out)


def set_hashes(features: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set; equal sets have equal ones."""
    a = int(_mix(features).sum(dtype=np.uint64)) if len(features) else 0
    b = int(_mix(features ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(features) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


#: The four 2-bit counts of each byte.
_COUNTS = np.stack([(np.arange(256) >> k) & 3 for k in (0, 2, 4, 6)], axis=1).astype(np.int8)


def sketch(features: np.ndarray) -> bytes:
    """Counts of features, up to 3, by equal ranges of the hash domain: two to four ranges a feature, 2 bits each."""
    bits = min(18, max(6, (2 * len(features)).bit_length()))
    tally = np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    c = np.minimum(tally, 3).astype(np.uint8).reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def _folded(s: bytes, size: int) -> np.ndarray:
    """Counts of a sketch with ranges joined until there are ``size``.

    They are cut at 3 again, which gives what a sketch of that size has: a joined range of 3 and
    more features shows 3 in either.
    """
    a = _COUNTS[np.frombuffer(s, dtype=np.uint8)].ravel()
    return np.minimum(a.reshape(size, -1).sum(axis=1), 3).astype(np.int8) if len(a) > size else a


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if sketches show more differences than a link of sets of these sizes may have."""
    size = 4 * min(len(a), len(b))
    return (100 + percent) * int(np.abs(_folded(a, size) - _folded(b, size)).sum(dtype=np.int64)) <= (100 - percent) * (na + nb)


def _bits(items: float) -> int:
    """Bits of a shard number, for shards of about SHARD_ITEMS; 24 at most, which leaves 40 of a hash."""
    return min(24, max(3, int(np.ceil(np.log2(max(items, 1) / SHARD_ITEMS)))))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, dtype=np.int64)


def _low_bytes(x: np.ndarray, count: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :count]).tobytes()


def _from_low_bytes(raw: np.ndarray, count: int) -> np.ndarray:
    wide = np.zeros((len(raw) // count, 8), dtype=np.uint8)
    wide[:, :count] = raw.reshape(-1, count)
    return wide.view("<u8").ravel()


def _frequent_codes(df: DataFrame, bits: int, words: int) -> np.ndarray:
    """Sorted codes (leading ``bits`` + CODE_BITS bits) of the shingles that FREQUENT or more documents hold.

    Every row counts, equal sets of a task once. A task sends each code of a block once, with
    its count where that is more than one; the bound of MOST_FREQUENT holds for what the driver gets.
    """
    size, shift = CODE_BITS // 8, np.uint64(64 - bits - CODE_BITS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        held = 0

        def flush():
            codes = np.sort(np.concatenate(sets) >> shift)
            first = _runs(codes)
            times = np.diff(np.concatenate((first, [len(codes)])))
            codes = codes[first]
            shard = (codes >> np.uint64(CODE_BITS)).astype(np.int64)
            cut = _runs(shard)
            ends = [*cut[1:].tolist(), len(codes)]
            blobs, more = [], []
            for x, y in zip(cut.tolist(), ends):
                many = np.flatnonzero(times[x:y] > 1)
                blobs.append(_low_bytes(codes[x:y], size))
                more.append(np.stack((codes[x:y][many].astype(np.int64), times[x:y][many]), axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], names=["shard", "codes", "more"])

        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                h = hash(s.tobytes())
                if len(s) and h not in seen:
                    seen.add(h)
                    sets.append(s)
                    held += len(s)
                    if held >= BLOCK_ITEMS:
                        yield from flush()
                        sets, held = [], 0
        if sets:
            yield from flush()
        give_back()

    def count(table: pa.Table) -> pa.Table:
        top = np.uint64(table.column("shard")[0].as_py() << CODE_BITS)
        codes = np.concatenate([_from_low_bytes(np.frombuffer(x.as_py(), dtype=np.uint8), size) for x in table.column("codes")]) | top
        pairs = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64).reshape(-1, 2) for x in table.column("more")])
        codes = np.sort(codes)
        first = _runs(codes)
        times = np.diff(np.concatenate((first, [len(codes)])))
        codes = codes[first]
        np.add.at(times, np.searchsorted(codes, pairs[:, 0].astype(np.uint64)), pairs[:, 1] - 1)
        many = times >= FREQUENT
        return pa.table({"code": codes[many].astype(np.int64), "times": times[many]})

    sent = df.select("text").mapInArrow(run, "shard long, codes binary, more binary")
    found = materialize(sent.groupBy("shard").applyInArrow(count, "code long, times long"), "frequent")
    # how many have which count (large counts as one) tells the least count that keeps within the bound
    steps = found.groupBy(F.least("times", F.lit(100_000)).alias("times")).count().orderBy(F.desc("times")).collect()
    least, kept = None, 0
    for r in steps:
        kept += r["count"]
        if kept > MOST_FREQUENT:
            break
        least = r["times"]
    if least is None:
        return np.empty(0, dtype=np.uint64)
    return np.sort(found.where(F.col("times") >= least).select("code").toPandas()["code"].to_numpy(dtype=np.int64).astype(np.uint64))


_SIGN_NAMES = ["shard", "base", "ids", "ns", "sketches", "blob"]
_SIGN_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
_SIGN_SCHEMA = "shard long, base long, ids array<long>, ns array<long>, sketches array<binary>, blob binary"


def _signed(df: DataFrame, frequent: np.ndarray, shift: int, bits: int, words: int, percent: int) -> DataFrame:
    """Rows of two sorts: blocks of documents (shard < 0: ids, set sizes, set hashes and row marks), and their
    signatures by shard, each with the document's place in its block.

    A task signs and sketches equal sets once, where their first row is, which names the class.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[tuple[int, int]] = set()
        part = TaskContext.get().partitionId()
        base, block, held = part << 36, 0, 0
        ids: list = []
        info: list = []
        sigs: list[np.ndarray] = []
        places: list[np.ndarray] = []

        def flush():
            marks = np.array([x[1] for x in info], dtype=np.int64)
            rows = [[-1 - (31 * part + block) % 4096], [base], [ids], [[x[0] for x in info]], [[x[2] for x in info]], [marks.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _SIGN_TYPES)], names=_SIGN_NAMES)
            if not sigs:
                return
            sig, place = np.concatenate(sigs), np.concatenate(places)
            order = np.argsort(sig)
            sig, place = sig[order], place[order]
            # shards are ranges of the hash: the sorted signatures are cut where they change
            shard = (sig >> np.uint64(64 - bits)).astype(np.int64)
            sig = sig >> np.uint64(64 - bits - KEY_BITS)
            cut = _runs(shard)
            ends = [*cut[1:].tolist(), len(sig)]
            blobs = [(int(shard[x]), _low_bytes(sig[x:y], KEY_BITS // 8) + place[x:y].astype("<u2").tobytes()) for x, y in zip(cut.tolist(), ends)]
            for at in range(0, len(blobs), 256):
                some = blobs[at : at + 256]
                rows = [[x[0] for x in some], [base] * len(some), *[[None] * len(some)] * 3, [x[1] for x in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _SIGN_TYPES)], names=_SIGN_NAMES)
            pa.default_memory_pool().release_unused()

        give_back()
        for b in batches:
            for i, t, mark in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                s = shingles(t.as_py(), words)
                h = set_hashes(s)
                fresh = len(s) > 0 and h not in seen
                if fresh:
                    seen.add(h)
                    got = signatures(s, frequent, percent, shift)
                    sigs.append(got)
                    places.append(np.full(len(got), len(ids), dtype=np.uint16))
                    held += len(got)
                ids.append(i)
                info.append((len(s), (*h, mark), sketch(s) if fresh else None))
                if len(ids) == BLOCK_DOCS or held >= BLOCK_ITEMS:
                    yield from flush()
                    base, block, held = base + len(ids), block + 1, 0
                    ids, info, sigs, places = [], [], [], []
        if ids:
            yield from flush()
        sigs, places = [], []
        give_back()

    return df.select("id", "text", "mark").mapInArrow(run, _SIGN_SCHEMA)


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("mark", pa.int64()), ("sketch", pa.binary())])


def _bucketed(table: pa.Table) -> pa.Table:
    """The rows of a shard; what its arrays took goes back before the next one comes."""
    out = _shard_rows(table)
    give_back()
    return out


def _shard_rows(table: pa.Table) -> pa.Table:
    """What a shard says: its documents (kind 0), buckets of two (1), members of buckets of three and more (2)."""
    shard = table.column("shard")[0].as_py()
    if shard < 0:
        rows = [[], [], [], [], [], [], []]
        for base, ids, ns, sk, blob in zip(*(table.column(c) for c in ("base", "ids", "ns", "sketches", "blob"))):
            h = np.frombuffer(blob.as_py(), dtype=np.int64).reshape(-1, 3)
            for c, v in zip(rows, (range(base.as_py(), base.as_py() + len(h)), ids.as_py(), ns.as_py(), *h.T.tolist(), sk.as_py())):
                c.extend(v)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip([[0] * len(rows[0]), *rows], _FOUND.types)], schema=_FOUND)
    wide = KEY_BITS // 8
    keys, uids = [], []
    for base, blob in zip(table.column("base"), table.column("blob")):
        raw = np.frombuffer(blob.as_py(), dtype=np.uint8)
        n = len(raw) // (wide + 2)
        keys.append(_from_low_bytes(raw[: wide * n], wide))
        uids.append(raw[wide * n :].view("<u2").astype(np.int64) + base.as_py())
    key, uid = np.concatenate(keys), np.concatenate(uids)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    near = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    key, uid = key[near], uid[order[near]]
    order = np.lexsort((uid, key))
    key, uid = key[order], uid[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (uid[1:] != uid[:-1]))) if len(key) else np.empty(0, bool)
    key, uid = key[fresh], uid[fresh]
    first = _runs(key)
    size = np.diff(np.concatenate((first, [len(key)])))
    two = first[size == 2]
    pairs = np.unique(np.stack((uid[two], uid[two + 1]), axis=1), axis=0)
    # buckets with the same members say the same: one of them is told
    marks = np.add.reduceat(_mix(uid.view(np.uint64)), first) if len(key) else np.empty(0, np.uint64)
    large = np.flatnonzero(size >= 3)
    _, once = np.unique(marks[large], return_index=True)
    told = large[once]
    members = np.concatenate([uid[first[j] : first[j] + size[j]] for j in told]) if len(told) else np.empty(0, np.int64)
    n, m = len(pairs), len(members)
    cols = [
        np.concatenate((np.ones(n, np.int32), np.full(m, 2, np.int32))),
        np.concatenate((pairs[:, 0], np.repeat(marks[told].view(np.int64), size[told]))),
        np.concatenate((pairs[:, 1], members)),
    ]
    nothing = pa.nulls(n + m, pa.int64())
    return pa.Table.from_arrays([*map(pa.array, cols), nothing, nothing, nothing, nothing, pa.nulls(n + m, pa.binary())], schema=_FOUND)


def _sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, part, features): the shingles of the nodes of ``pairs``, a bounded number a row."""
    want = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    rows = materialize(want.join(nodes.select(F.col("uid").alias("node"), "id", "h1", "h2"), "node"), "wanted")
    ids = sized_broadcast(rows.select(F.col("id").alias("want")).distinct(), rows.count(), BROADCAST_IDS)
    names = ["h1", "h2", "n", "part", "features"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                h = set_hashes(s)
                for part, at in enumerate(range(0, len(s), PART_SHINGLES)):
                    for c, v in zip(out, (*h, len(s), part, s[at : at + PART_SHINGLES].tobytes())):
                        c.append(v)
                held += len(s)
                if held >= BLOCK_ITEMS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            out = []
        give_back()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    some = docs.join(ids, docs["id"].eqNullSafe(F.col("want")), "left_semi").select("text").mapInArrow(run, "h1 long, h2 long, n long, part int, features binary")
    got = some.join(rows.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "n", "part", "features").dropDuplicates(["node", "part"])
    return materialize(got, "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, by the shingles of both.

    The document of a pair that has more pairs leads; its pairs are dealt into groups of about
    GROUP_PAIRS, and a group gets the leader's shingles once. Rows come sorted, the leader's
    first, so a task holds one set and compares the others with it part by part.
    """
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).groupBy("node").count()
    one, two = ends.select(F.col("node").alias("u"), F.col("count").alias("cu")), ends.select(F.col("node").alias("v"), F.col("count").alias("cv"))
    both = pairs.select("u", "v").join(one, "u").join(two, "v")
    first = F.col("cu") >= F.col("cv")
    led = both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("v"), F.greatest("cu", "cv").alias("c"))
    led = materialize(led.select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / GROUP_PAIRS)).alias("salt")), "led")
    heads = led.select("u", "salt").distinct().join(sets.withColumnRenamed("node", "u"), "u").select("u", "salt", F.lit(-1).cast("long").alias("v"), "n", "part", "features")
    rest = led.join(sets.withColumnRenamed("node", "v"), "v").select("u", "salt", "v", "n", "part", "features")

    def run(batches):
        at, left, parts, now, hits, size = None, None, [], None, 0, 0

        def linked() -> bool:
            return now is not None and 100 * hits >= percent * (len(left) + size - hits)

        for b in batches:
            keep: list[tuple[int, int]] = []
            for u, salt, v, n, s in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3)), b.column(5)):
                f = np.frombuffer(s.as_py(), dtype=np.uint64)
                if (u, salt, v) != now:
                    if linked():
                        keep.append((now[0], now[2]))
                    now = None
                if v < 0:
                    if (u, salt) != at:
                        at, parts = (u, salt), []
                    parts.append(f)
                    continue
                if parts:
                    left, parts = np.concatenate(parts), []
                if now is None:
                    now, hits, size = (u, salt, v), 0, n
                spot = np.minimum(np.searchsorted(left, f), len(left) - 1)
                hits += int((left[spot] == f).sum())
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in keep], pa.int64()), pa.array([max(x) for x in keep], pa.int64())], names=["u", "v"])
        if linked():
            yield pa.RecordBatch.from_arrays([pa.array([min(now[0], now[2])]), pa.array([max(now[0], now[2])])], names=["u", "v"])
        left, parts = None, []
        give_back()

    rows = heads.unionByName(rest).repartition("u", "salt").sortWithinPartitions("u", "salt", "v", "part")
    return rows.select("u", "salt", "v", "n", "part", "features").mapInArrow(run, "u long, v long")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, stored; the shingles that told so are dropped."""
    sets = _sets(docs, pairs, nodes, words)
    links = materialize(_verified(pairs, sets, percent), "links")
    release(sets)
    return links


def _components(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(uid, id, n, mark, component_id, component): every row, the smallest id that its links reach and a number of its component.

    ``component_id`` and ``component`` are null for rows without words.
    """
    with batch_bytes(df.sparkSession, BATCH_BYTES):
        return _classes(df, id_col, text_col, words, percent)


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(size * BY_BYTE)
    frequent = _frequent_codes(docs, bits, words)
    signed = _signed(docs, frequent, 64 - bits - CODE_BITS, bits, words, percent)
    schema = "kind int, a long, b long, n long, h1 long, h2 long, mark long, sketch binary"
    found = materialize(signed.groupBy("shard").applyInArrow(_bucketed, schema), "found")

    nodes = found.where("kind = 0").select(F.col("a").alias("uid"), F.col("b").alias("id"), "n", "h1", "h2", "mark")
    # a class is a set; it is named by the first row that has it, and known by its smallest id
    classes = materialize(nodes.where("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("node"), F.min("id").alias("id"), F.max("n").alias("n")), "classes")
    named = nodes.where("n > 0").select("uid", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("uid", "node")
    to_node = materialize(named, "nodes")
    sketches = found.where("kind = 0 and sketch is not null").select(F.col("a").alias("node"), "n", "sketch")

    # how many shards tell a bucket of these members counts for its leader
    members = found.where("kind = 2").select(F.col("a").alias("bucket"), F.col("b").alias("uid")).join(to_node, "uid")
    members = materialize(members.groupBy("bucket", "node").agg(F.count("*").alias("told")), "members")
    raw = found.where("kind = 1").select(F.col("a").alias("p"), F.col("b").alias("q")).distinct()
    left, right = to_node.select(F.col("uid").alias("p"), F.col("node").alias("u")), to_node.select(F.col("uid").alias("q"), F.col("node").alias("v"))
    pairs = raw.join(left, "p").join(right, "q").select("u", "v").unionByName(_with_leaders(members)).where("u <> v")
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(_near(pairs, sketches, percent), "pairs")
    links = _links(pairs, docs, nodes, words, percent)

    # buckets whose members are still apart: their members are compared across components
    home = materialize(connected_components(links, "u", "v"), "components")
    tried, cut = pairs, None
    for most in (NEAREST, None):
        now = members.join(home, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        if cut is not None:
            now = now.join(cut, "component", "left_semi")
        apart = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("bucket", "size")
        cross = _across(now.join(apart, "bucket").join(sketches, "node"), percent, most)
        cross = materialize(cross.groupBy("u", "v").agg(F.min("rank").alias("rank"), F.max("more").alias("more")), "cross")
        # the nearest pair of two components goes first: where it links, the others need no look
        for which in ("rank = 0", "rank > 0"):
            fresh = _still_apart(cross.where(which).join(tried, ["u", "v"], "left_anti"), home)
            fresh = materialize(fresh.select("u", "v"), "untried")
            if fresh.isEmpty():
                continue
            tried = tried.unionByName(fresh)
            more = _links(fresh, docs, nodes, words, percent)
            if not more.isEmpty():
                links = links.unionByName(more)
                home = materialize(connected_components(links, "u", "v"), "components")
        # pairs were left out between these components, and nothing has joined them since
        left_out = _still_apart(cross.where("more"), home)
        cut = materialize(left_out.select(F.explode(F.array("home_u", "home_v")).alias("component")).distinct(), "open")
        if cut.isEmpty():
            break

    # smallest id of each component, over the smallest ids of its classes
    placed = classes.join(home, "node", "left").select("h1", "h2", "id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    final = materialize(placed.join(least, "component").select("h1", "h2", "component", "component_id"), "final")
    return nodes.join(final, ["h1", "h2"], "left").select("uid", "id", "n", "mark", "component_id", "component")


def _with_leaders(members: DataFrame) -> DataFrame:
    """(u, v): the leader of each bucket and each member of it.

    The document that shares most with others over all buckets leads: it is likeliest to link to them.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    shared = members.join(sizes, "bucket").groupBy("node").agg(F.sum(F.col("told") * F.col("size")).alias("shared"))
    first = F.max(F.struct("shared", (-F.col("node")).alias("minus")))
    leaders = members.join(shared, "node").groupBy("bucket").agg((-first["minus"]).alias("u"))
    return members.join(leaders, "bucket").select("u", F.col("node").alias("v"))


def _still_apart(pairs: DataFrame, home: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) whose ends lie in different components, named home_u and home_v; a node without links is its own."""
    for c in ("u", "v"):
        place = home.select(F.col("node").alias(c), F.col("component").alias(f"home_{c}"))
        pairs = pairs.join(place, c, "left").withColumn(f"home_{c}", F.coalesce(f"home_{c}", c))
    return pairs.where("home_u <> home_v")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles long, component_id): each row with the smallest id that links reach.

    Defined cases: null or blank text is an empty set, linked with nothing; rows with equal sets
    are linked, however many; a null id takes part and is never the smallest unless alone;
    repeated rows give repeated results; other columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    return _components(df, id_col, text_col, words, percent).select(
        F.col("id").cast(id_type).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).cast(id_type).alias("component_id"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``df``, all columns: of each component one row with the smallest id.

    A row is known by its id and a 64-bit hash of its text, so unlike rows with one id are judged
    apart. Defined cases: rows without words all stay; a null id comes after all others; of rows
    that repeat id and text of the one that stays, one stays.
    """
    rows = materialize(_components(df, id_col, text_col, words, percent).where("component is not null"), "components")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))
    best = rows.groupBy("component").agg(first.alias("first")).select("component", F.col("first.id").alias("best_id"), F.col("first.mark").alias("best_mark"))
    told = rows.join(best, "component").withColumn("stays", F.col("id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark")))
    sums = materialize(told.groupBy("id", "mark").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")), "judged")
    key = F.col(id_col).cast("long").eqNullSafe(F.col("_near_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_near_mark"))
    marked = sums.select(F.col("id").alias("_near_id"), F.col("mark").alias("_near_mark"), "stays", "rows")
    lost = marked.where("not stays or rows > 1").select("_near_id", "_near_mark")
    out = df.join(sized_broadcast(lost, lost.count(), BROADCAST_IDS), key, "left_anti")
    twice = marked.where("stays and rows > 1").select("_near_id", "_near_mark")
    if twice.isEmpty():
        return out
    again = df.join(sized_broadcast(twice, twice.count(), BROADCAST_IDS), key, "left_semi")
    return out.unionByName(again.dropDuplicates([id_col, text_col]))


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that sketches do not rule out."""

    def run(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(2, 6)]
            keep = pa.array([j for j, (na, nb, x, y) in enumerate(zip(*cols)) if 100 * min(na, nb) >= percent * max(na, nb) and may_link(x, y, na, nb, percent)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["u", "v"])

    one = sketches.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    two = sketches.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    return pairs.join(two, "v").join(one, "u").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


@lru_cache(maxsize=1)
def _block_pairs() -> tuple[np.ndarray, np.ndarray]:
    j, i = np.tril_indices(BLOCK_MEMBERS, -1)
    return i, j


def _upper(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of m rows; by j, so that those of fewer rows come first and one table serves all sizes of a block."""
    if m > BLOCK_MEMBERS:
        return np.triu_indices(m, 1)
    i, j = _block_pairs()
    return i[: m * (m - 1) // 2], j[: m * (m - 1) // 2]


def _across(members: DataFrame, percent: int, most: int | None, block: int = BLOCK_MEMBERS) -> DataFrame:
    """Pairs (u, v) of members of one bucket in different components that sketches do not rule out.

    Of each two components in a bucket the ``most`` nearest pairs by sketch, or all; ``rank`` is
    a pair's place among them and ``more`` tells that others were left out. A bucket of more
    than ``block`` members is cut into blocks, and a group compares two of them, so no group
    grows with a bucket. A pair is told once for each bucket that shows it, or less.
    """
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    others = F.sequence(F.lit(0), count - 1)
    rows = members.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "n", "sketch")

    def pairs(g: dict[str, np.ndarray], x: int, y: int) -> np.ndarray | None:
        """Rows (u, v, rank, more) of the group in rows x to y, which are sorted by size."""
        home, n, own, node = (g[c][x:y] for c in ("component", "n", "own", "node"))
        i, j = _upper(y - x)
        ok = (home[i] != home[j]) & (100 * n[i] >= percent * n[j])
        if g["lo"][x] != g["hi"][x]:
            ok &= own[i] != own[j]
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        size = 4 * min(map(len, g["sketch"][x:y]))
        table = np.vstack([_folded(s, size) for s in g["sketch"][x:y]])
        step = max(1, BLOCK_CELLS // size)
        apart = np.concatenate([np.abs(table[j[k : k + step]] - table[i[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)])
        ok = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
        if not ok.any():
            return None
        i, j, apart = i[ok], j[ok], apart[ok]
        a, b = np.minimum(home[i], home[j]), np.maximum(home[i], home[j])
        u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        order = np.lexsort((v, u, apart, b, a))
        a, b, u, v = a[order], b[order], u[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        total = np.diff(np.concatenate((first, [len(a)])))
        rank = np.arange(len(a)) - np.repeat(first, total)
        if most is None:
            return np.stack((u, v, rank, np.zeros_like(u)), axis=1)
        keep = rank < most
        return np.stack((u, v, rank, np.repeat(total > most, total).astype(np.int64)), axis=1)[keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups follow one another in sorted rows; the last of a frame may go on in the next."""
        rest = None
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            key = pdf[["bucket", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            rest = pdf.iloc[int(cut[-1]) if len(cut) else 0 :]
            yield told(pdf, cut)
        if rest is not None:
            yield told(rest, np.array([len(rest)]))
        rest = None
        give_back()

    def told(pdf: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
        g = {c: pdf[c].to_numpy() for c in pdf.columns}
        ends = cut.tolist()
        out = [r for x, y in zip([0, *ends[:-1]], ends) if (r := pairs(g, x, y)) is not None]
        # buckets of a family repeat its pairs: each is told once a frame
        both = pd.DataFrame(np.concatenate(out) if out else np.empty((0, 4), np.int64), columns=["u", "v", "rank", "more"])
        both = both.groupby(["u", "v"], as_index=False).agg({"rank": "min", "more": "max"})
        return both.assign(more=both["more"] > 0)

    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n", "node")
    return dealt.mapInPandas(run, "u long, v long, rank long, more boolean")
