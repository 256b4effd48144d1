"""Token pieces and best-fit packing into fixed-length sequences by swap-based local search.

``tokenize_pieces`` turns texts into pieces of at most ``capacity`` ids; ``pack`` deals pieces
into groups of bounded size, packs each group best-fit and then improves it: documents move,
or are exchanged one-for-one and two-for-one, between underfull bins whenever that raises the
sum of squared fills, until bins empty. What is left in the underfull bins of many groups is
packed once more, so groups do not each keep a part-filled bin.

Defined cases: null text counts as empty; an empty text is one piece that holds the end id
alone; null or repeated ids are kept apart as rows; a table without rows gives one without
rows; only the named columns are read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .bpe import _arrow_type
from .memory import give_back

CAPACITY = 4096
END_ID = 1
#: Pieces a group holds on average: what one task packs at a time.
GROUP_PIECES = 20_000
#: Bins below this share of the capacity are packed again across groups.
REPACK_BELOW = 0.98
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 100_000
#: Bytes of pieces that a task gathers before it sends them.
PIECE_BYTES = 2 << 20
#: Characters for which lower-casing and white space may differ between Python and the tokenizer.
_ODD = re.compile("[\x1c-\x1f\x85İɐ-\U0010ffff]")


class WordBpe:
    """Ids by the vocabulary and merges of a tokenizers file with word ends (``</w>``).

    White space is dropped before the merges, so the ids of a text are those of its words one
    after another; each word is encoded once and its packed ids are kept. Texts with
    characters outside the common range, or with an added token of the file written out, go
    through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path) as f:
            spec = json.load(f)
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        model, self.special = spec["model"], {}
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # a word's last byte carries the end mark 0xff, which UTF-8 never holds; the marks join first
        plain = {c: b for b, c in _byte_letters().items()}
        raw = lambda t: bytes(plain[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>")
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in plain for c in t.removesuffix("</w>"))}
        order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(255)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        order += [raw(a) + raw(b) for a, b in pairs]
        rank = {t: r for r, t in enumerate(dict.fromkeys(order))}
        self.packed = [np.uint32(ids.get(t, 0)).tobytes() for t in rank]
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=rank, special_tokens={})._core_bpe.encode_single_piece
        self.cache = _Chunks(self)

    @cached_property
    def full(self):
        """The library's tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Packed little-endian ids of one text, as the library gives them without adding special tokens."""
        low = text.lower()
        if _ODD.search(text) or any(t in low for t in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, low.split()))


class _Chunks(dict):
    """Packed ids by lower-case chunk without white space."""

    def __init__(self, owner: WordBpe):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        o = self.owner
        if chunk.isalpha():
            out = b"".join([o.packed[i] for i in o.merge(chunk.encode() + b"\xff")])
        elif (words := o.words.findall(chunk)) == [chunk]:
            out = b"".join([o.packed[i] for i in o.merge(chunk.encode() + b"\xff")])
        else:
            out = b"".join([self[w] for w in words])
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = out
        return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer a worker process."""
    return WordBpe(path)


def tokenize_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece int, start long, length long, ids binary): the pieces of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = _arrow_type(df, id_col)
    names = [id_col, "piece", "start", "length", "ids"]
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        give_back()  # an earlier job of the worker may have left much
        bpe, end = word_bpe(tokenizer_path), np.uint32(end_id).tobytes()
        out: list[list] = [[] for _ in names]
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = bpe.encode(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (i, k, at // 4, len(part) // 4, part)):
                        c.append(v)
                    held += len(part) + 64
                    if held >= PIECE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(out, types)], names=names)
                        out, held = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(out, types)], names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each length (1 to capacity): best fit by falling length, then local search."""
    n = len(lengths)
    where = np.empty(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    # open bins by free space: what is free is at most capacity, so lists by free space are few
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []
    for k in order.tolist():
        need = int(lengths[k])
        at = bisect_left(spaces, need)
        if at == len(spaces):
            b, space = len(bins), capacity
            bins.append([])
        else:
            space = spaces[at]
            b = free[space].pop()
            if not free[space]:
                del spaces[at]
        bins[b].append(k)
        space -= need
        if space:
            if not free[space]:
                insort(spaces, space)
            free[space].append(b)
    _local_search(bins, lengths, capacity)
    for number, members in enumerate(b for b in bins if b):
        where[members] = number
    return where


def _local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
    """Move and exchange documents between underfull bins while squared fill increases.

    In each round every underfull bin gives once, the emptiest first: a document or two move to a
    fuller bin with room, or are exchanged against one document of that bin so that the fuller
    one gets fuller. Every step raises the sum of squared fills; the search ends with the first
    round without a step.
    """
    stock: list[dict[int, list[int]]] = [{} for _ in bins]
    for x, b in enumerate(bins):
        for k in b:
            stock[x].setdefault(int(lengths[k]), []).append(k)
    fill = [sum(size * len(ks) for size, ks in s.items()) for s in stock]
    while _round(stock, fill, capacity):
        pass
    for x, s in enumerate(stock):
        bins[x][:] = [k for ks in s.values() for k in ks]


def _round(stock: list[dict[int, list[int]]], fill: list[int], capacity: int) -> bool:
    """One turn of every underfull bin as giver; True if there was a step."""
    takers, changed = _Takers(stock, fill, capacity), False
    turn = [(f, x) for x, f in enumerate(fill) if 0 < f < capacity]
    for _, x in turn:
        takers.add(x)
    heapify(turn)
    while turn:
        f, g = heappop(turn)
        if f < fill[g]:  # got fuller as taker
            if fill[g] < capacity:
                heappush(turn, (fill[g], g))
            continue
        takers.remove(g)  # what is left is at least as full as the giver
        while step := takers.best(stock[g]):
            give, back, t = step
            takers.remove(t)
            for a, b, sizes in ((g, t, give), (t, g, back)):
                for size in sizes:
                    stock[b].setdefault(size, []).append(stock[a][size].pop())
                    if not stock[a][size]:
                        del stock[a][size]
            gain = sum(give) - sum(back)
            fill[t] += gain
            fill[g] -= gain
            takers.add(t)
            changed = True
    return changed


class _Takers:
    """Underfull bins by what they can take: ``least[v]`` is the smallest length (0: none) that a bin
    can give back for a document of length v and then be exactly full."""

    def __init__(self, stock: list[dict[int, list[int]]], fill: list[int], capacity: int):
        self.stock, self.fill, self.capacity = stock, fill, capacity
        self.none = capacity + 1
        self.least = np.full(capacity + 1, self.none)
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.stamp = [0] * len(fill)
        self.reach: np.ndarray | None = None

    def add(self, t: int) -> None:
        free = self.capacity - self.fill[t]
        if free:
            for size in (0, *self.stock[t]):
                heappush(self.slots[size + free], (size, t, self.stamp[t]))
                self.least[size + free] = min(size, self.least[size + free])
            self.reach = None

    def remove(self, t: int) -> None:
        self.stamp[t] += 1
        free = self.capacity - self.fill[t]
        for size in (0, *self.stock[t]):
            slot = self.slots[size + free]
            while slot and slot[0][2] != self.stamp[slot[0][1]]:
                heappop(slot)
            self.least[size + free] = slot[0][0] if slot else self.none
        self.reach = None

    def best(self, mine: dict[int, list[int]]) -> tuple[tuple[int, ...], tuple[int, ...], int] | None:
        """(lengths given, lengths given back, taker) of the largest gain."""
        if not mine:
            return None
        offers: dict[int, tuple[int, ...]] = {a: (a,) for a in mine}
        sizes = list(mine)
        for i, a in enumerate(sizes):
            if len(mine[a]) > 1:
                offers.setdefault(2 * a, (a, a))
            for c in sizes[i + 1 :]:
                offers.setdefault(a + c, (a, c))
        if self.reach is None:
            self.reach = np.minimum.accumulate(self.least[::-1])[::-1]
        values = np.fromiter(offers, np.int64, len(offers))
        gains = values - self.reach[values]
        k = int(gains.argmax())
        if gains[k] <= 0:
            return None
        v = int(values[k])
        back = int(self.reach[v])
        slot = self.slots[v + int((self.least[v:] == back).argmax())]  # the fullest of equal ones
        return offers[v], (back,) if back else (), slot[0][1]


def _place(df: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins and gapless offsets of one group's pieces, rows in a stable order."""
    df = df.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
    df["bin"] = pack_lengths(df["length"].to_numpy(), capacity)
    df = df.sort_values(["bin", "uid"], kind="stable").reset_index(drop=True)
    df["offset"] = df.groupby("bin")["length"].cumsum() - df["length"]
    df["fill"] = df.groupby("bin")["length"].transform("sum")
    return df


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` of 1 to capacity) with sequence_id and offset.

    The pieces are stored first: they are read
    twice and rows are numbered by their place. Columns named uid, sequence_id or offset are
    replaced. Groups are dealt by a hash of that number, so
    they are even whatever keys the rows hold.
    """
    pieces = pieces.drop("uid", "sequence_id", "offset")
    stored = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-stored.count() // group_pieces))
    kind = "uid long, length long, `group` long, bin long, `offset` long, fill long"

    def first(df: pd.DataFrame) -> pd.DataFrame:
        return _place(df, capacity)[["uid", "length", "group", "bin", "offset", "fill"]]

    keyed = stored.select("uid", "length").withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    if groups > 1:
        keyed = keyed.repartition(min(groups, 4096), "group")
    placed = materialize(keyed.groupBy("group").applyInPandas(first, kind), "packed")
    done = placed
    if groups > 1:
        # the underfull bins of a hundred and more groups together fill about one group again
        low = F.col("fill") < F.lit(int(capacity * REPACK_BELOW))
        again = placed.where(low).select("uid", "length").withColumn("group", F.lit(-1).cast("long"))
        left = again.count()
        heaps = max(1, -(-left // group_pieces))
        again = again.withColumn("group", -1 - F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(heaps)))
        done = placed.where(~low).unionByName(again.groupBy("group").applyInPandas(first, kind))
    # bins of a group are numbered below 2^31: group and bin together name a sequence
    where = done.select("uid", (F.col("group") * F.lit(1 << 31) + F.col("bin")).alias("sequence_id"), "offset")
    return stored.join(where, "uid").drop("uid")
