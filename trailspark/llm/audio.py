"""Media columns: lossless 8-bit audio and features of it as fixed-shape tensors with time spans.

``store`` gives bytes as unsigned 8-bit mono WAV in a binary column and writes them as a table;
``features`` reads the stored bytes back: a polyphase filter halves the rate, overlapped windows
give log-mel filterbanks, cut into tensors of TENSOR_FRAMES x MELS, and energy with hysteresis
gives time spans of activity. Each task writes its tensors, with the time span of each, to an
Arrow file of the shared folder whose column has Arrow's fixed-shape tensor type; rows of the
features say which rows of which file are theirs, and ``read_tensors`` reads them back. Long
payloads run in blocks, so memory is bounded by the stored bytes and their features.

A file is named after its task attempt and told of only by rows that its task returned, so lost
or repeated attempts leave nothing but unread files.

Defined cases: null counts as empty; an empty payload is padded to one unit of 64 zero bytes;
the last tensor is padded with the floor value; null or repeated ids give a row each; a table
without rows gives none; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, new_path
from .bpe import BATCH_BYTES, _arrow_type
from .warc import open_path

RATE, UNIT = 8000, 64
#: The rate is halved by a filter of TAPS taps, half of them in each phase.
TAPS = 32
WINDOW, HOP, MELS, TENSOR_FRAMES = 256, 128, 16, 64
#: Decibels over the floor at which a span opens and below which it closes.
OPEN_DB, CLOSE_DB = 12.0, 6.0
#: Frames worked on at a time.
BLOCK_FRAMES = 2048
FLOOR = 1e-10


def wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono WAV of a payload of even length."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload


def read_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low-pass taps (windowed sinc at half the new rate), analysis window, mel weights."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    taps = np.sinc(t / 2) / 2 * np.hamming(TAPS)
    taps = (taps / taps.sum()).astype(np.float32)
    rate = RATE / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / rate)
    up = (f[None, :] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - f[None, :]) / (points[2:] - points[1:-1])[:, None]
    return taps, np.hanning(WINDOW).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def halve(x: np.ndarray) -> np.ndarray:
    """Samples at half the rate: two phases of the filter run at the lower rate and are summed."""
    taps, _, _ = _filters()
    n = -(-len(x) // 2)
    pad = TAPS // 2
    y = np.concatenate((np.zeros(pad, np.float32), x, np.zeros(pad + 2, np.float32)))
    out = np.zeros(n, dtype=np.float32)
    for phase in (0, 1):
        h, s = taps[phase::2], y[phase::2]
        out += np.convolve(s, h[::-1], mode="valid")[:n]
    return out


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log-mel energies, energy in decibels of each frame), float32, at least one frame."""
    _, window, weights = _filters()
    samples = np.frombuffer(payload, dtype=np.uint8)
    frames = max(1, 1 + (len(samples) // 2 - WINDOW) // HOP)
    mels, power = [], []
    for at in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - at)
        # the block's samples at the full rate, with a margin that keeps filter edges outside
        a, b = 2 * HOP * at, 2 * (HOP * (at + n - 1) + WINDOW)
        margin = min(a, TAPS)
        x = (samples[a - margin : b + TAPS].astype(np.float32) - 128) / 128
        y = halve(x)[margin // 2 :]
        need = HOP * (n - 1) + WINDOW
        y = np.pad(y, (0, max(0, need - len(y))))[:need]
        view = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        spectrum = np.abs(np.fft.rfft(view * window, axis=1)).astype(np.float32) ** 2
        mels.append(np.log(spectrum @ weights.T + FLOOR).astype(np.float32))
        power.append(10 * np.log10((view * view).mean(axis=1) + FLOOR))
    return np.concatenate(mels), np.concatenate(power).astype(np.float32)


def active_spans(power: np.ndarray) -> list[tuple[float, float]]:
    """(start, end) in seconds of spans that open at OPEN_DB over the floor and close below CLOSE_DB."""
    floor = float(np.quantile(power, 0.1))
    # the state changes only at frames beyond a threshold; between them the last change holds
    signal = np.where(power >= floor + OPEN_DB, 1, np.where(power < floor + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(signal != 0, np.arange(len(signal)), -1))
    on = (last >= 0) & (signal[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    step = HOP / (RATE / 2)
    return [(a * step, (b - 1) * step + WINDOW / (RATE / 2)) for a, b in edges.reshape(-1, 2).tolist()]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): the UTF-8 bytes of each whole text, padded, as WAV."""
    kind, id_type = df.schema[id_col].dataType.simpleString(), _arrow_type(df, id_col)
    names, types = [id_col, "n_bytes", "media"], [id_type, pa.int64(), pa.binary()]

    def rows(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                yield i, len(raw), wav(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))

    return df.select(id_col, text_col).mapInArrow(lambda batches: _batches(rows(batches), names, types, 2), f"`{id_col}` {kind}, n_bytes long, media binary")


#: What features() tells of each row.
FEATURE_SCHEMA = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, "
    "file string, first long, count long, span_starts array<double>, span_ends array<double>"
)
#: Tensors of a batch of a tensor file.
FILE_BATCH = 256
#: Arrow's type of a tensor, and the columns of a tensor file.
TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
TENSOR_FILE = pa.schema([("tensor", TENSOR), ("start", pa.float64()), ("end", pa.float64())])


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): the UTF-8 bytes of each whole text, padded, as a stored table."""
    return materialize(encode(df, id_col, text_col), "media", "zstd")


class _TensorFile:
    """Writes tensors with their time spans to one Arrow file, in batches of FILE_BATCH."""

    def __init__(self, path: str):
        store, inner = open_path(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.sink, self.rows, self.held = path, store.open_output_stream(inner, compression=None), 0, []
        self.out = pa.ipc.new_file(self.sink, TENSOR_FILE, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, tensors: np.ndarray, starts: list[float], ends: list[float]) -> int:
        """Number of the first row of these tensors."""
        first = self.rows
        self.held += zip(tensors, starts, ends)
        self.rows += len(starts)
        while len(self.held) >= FILE_BATCH:
            self._write(FILE_BATCH)
        return first

    def _write(self, n: int) -> None:
        some, self.held = self.held[:n], self.held[n:]
        columns = [tensor_array([x[0].ravel() for x in some]), pa.array([x[1] for x in some]), pa.array([x[2] for x in some])]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSOR_FILE))

    def close(self) -> None:
        if self.held:
            self._write(len(self.held))
        self.out.close()
        self.sink.close()


def features(stored: DataFrame, id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(id, n_bytes, digests of the payload read back and of the stored form, frames, place of the tensors, active spans), stored."""
    kind, id_type = stored.schema[id_col].dataType.simpleString(), _arrow_type(stored, id_col)
    folder = folder or new_path(stored.sparkSession, "tensors")
    names = [id_col, "n_bytes", *(x.split()[0] for x in FEATURE_SCHEMA.split(", "))]
    floats = pa.list_(pa.float64())
    types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), floats, floats]

    def rows(batches):
        step, file = HOP / (RATE / 2), None
        for b in batches:
            for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                media = m.as_py()
                payload = read_wav(media)
                mel, power = log_mel(payload)
                count = -(-len(mel) // TENSOR_FRAMES)
                full = np.full((count * TENSOR_FRAMES, MELS), np.log(FLOOR), dtype=np.float32)
                full[: len(mel)] = mel
                if file is None:
                    file = _TensorFile(f"{folder}/part-{uuid.uuid4().hex}.arrow")
                starts = [k * TENSOR_FRAMES * step for k in range(count)]
                ends = [(min(len(mel), (k + 1) * TENSOR_FRAMES) - 1) * step + WINDOW / (RATE / 2) for k in range(count)]
                first = file.add(full.reshape(count, TENSOR_FRAMES, MELS), starts, ends)
                spans = active_spans(power)
                told = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mel))
                yield i, n, *told, file.path, first, count, [a for a, _ in spans], [e for _, e in spans]
        if file is not None:
            file.close()

    schema = f"`{id_col}` {kind}, n_bytes long, {FEATURE_SCHEMA}"
    return materialize(stored.select(id_col, "n_bytes", "media").mapInArrow(lambda batches: _batches(rows(batches), names, types, None), schema), "features")


def read_tensors(found: DataFrame) -> DataFrame:
    """``found`` (rows of :func:`features`, other columns may follow) with ``tensors array<array<float>>``, row by row, read from their files."""
    session = found.sparkSession
    files = found.agg(F.count_distinct("file")).first()[0]
    tasks = max(session.sparkContext.defaultParallelism, files)
    at, names = {c: k for k, c in enumerate(found.columns)}, [*found.columns, "tensors"]
    kind = pa.list_(pa.list_(pa.float32()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        path, reader, number, batch = None, None, None, None
        for b in batches:
            start, out, held = 0, [], 0
            for k, (file, first, count) in enumerate(zip(*(b.column(at[c]).to_pylist() for c in ("file", "first", "count")))):
                if file != path:
                    store, inner = open_path(file)
                    path, reader, number = file, pa.ipc.open_file(store.open_input_file(inner)), None
                got = []
                for row in range(first, first + count):
                    if row // FILE_BATCH != number:
                        number = row // FILE_BATCH
                        batch = reader.get_batch(number).column(0).to_numpy_ndarray()
                    got.append(batch[row % FILE_BATCH].ravel())
                out.append(got)
                held += count
                if held * TENSOR_FRAMES * MELS * 4 >= BATCH_BYTES or k + 1 == b.num_rows:
                    part = b.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=names)
                    start, out, held = k + 1, [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.repartition(tasks, "file").sortWithinPartitions("file", "first").mapInArrow(run, f"{fields}, tensors array<array<float>>")


def tensor_array(tensors: list[np.ndarray]) -> pa.ExtensionArray:
    """Rows of TENSOR_FRAMES x MELS floats as an Array of Arrow's fixed-shape tensor type."""
    flat = np.concatenate(tensors) if tensors else np.empty(0, np.float32)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), TENSOR_FRAMES * MELS))


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weight: int | None) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in names]
    held = 0
    for row in rows:
        for c, v in zip(out, row):
            c.append(v)
        held += 512 if weight is None else len(row[weight]) + 64
        if held >= BATCH_BYTES // 4:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            out, held = [[] for _ in names], 0
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
