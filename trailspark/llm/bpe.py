"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Ids travel as packed little-endian unsigned 32-bit integers (``binary``): four bytes a token
between Python and the JVM, hashable as they are; :func:`unpack_ids` gives an array.

Defined cases: a null text encodes as the empty text (no ids); an empty text has no ids; null
or malformed packed ids decode to empty bytes or raise ValueError; input rows are never merged
or dropped, so repeated rows give repeated results; only the named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are cut at safe boundaries before they are encoded.
CHUNK_CHARS = 1 << 16
#: A row of output batches holds about this many bytes at most, or one document.
BATCH_BYTES = 8 << 20
_BOUNDARY = regex.compile(r"(?<=[A-Za-z0-9.,;:!?\p{L}])(?= )")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file; one a worker process."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only where a match must end.

    A cut lies between a visible character and a space. No alternative of the pattern holds a
    visible character before a space, and a space opens the next match whatever stands before
    it, so the matches of the pieces are those of the whole. Where no such place exists, a
    piece is as long as it has to be.
    """
    start, n = 0, len(text)
    while n - start > size:
        m = _BOUNDARY.search(text, start + size)
        if m is None or m.start() >= n:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode_text(text: str, enc) -> np.ndarray:
    """Ids of one text as ``uint32``."""
    if len(text) <= CHUNK_CHARS:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(x), dtype="<u4") for x in safe_chunks(text)])


def _flushing(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES, by the bytes in column ``weight`` of each row."""
    out: list[list] = [[] for _ in names]
    held = 0
    for row in rows:
        for c, v in zip(out, row):
            c.append(v)
        held += len(row[weight]) + 64
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            out, held = [[] for _ in names], 0
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens long): every whole text, without special tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_path, pattern)

        def rows():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = encode_text(t.as_py() or "", enc)
                    yield i, ids.tobytes(), len(ids)

        yield from _flushing(rows(), [id_col, "ids", "n_tokens"], [id_type, pa.binary(), pa.int64()], 1)

    id_type = _arrow_type(df, id_col)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long")


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the raw bytes of packed ids, which need not be valid UTF-8."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_path, pattern)

        def rows():
            for b in batches:
                for i, p in zip(b.column(0).to_pylist(), b.column(1)):
                    packed = p.as_py() or b""
                    yield i, packed, enc.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())

        yield from _flushing(rows(), [id_col, "ids", "decoded"], [id_type, pa.binary(), pa.binary()], 1)

    id_type = _arrow_type(df, id_col)
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def unpack_ids(ids: Column) -> Column:
    """array<long> of packed ids, by built-in functions."""
    h = F.hex(ids)
    n = (F.length(h) / 8).cast("int")
    one = lambda i: F.concat(*[F.substring(h, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(one(i), 16, 10).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)
