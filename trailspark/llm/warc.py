"""WARC archives with a two-level capture index.

``write_archive`` writes one gzip member a record into part files of the shared folder, from
the tasks that hold the rows. ``build_index`` sorts captures by reversed-host URL key into
compressed blocks and keeps a sparse directory with the first key of each block. ``lookup``
sorts the wanted keys the same way; each task binary-searches the list of index parts, the
directory of a part and a block, then reads the records by byte range.

Files are reached with pyarrow's file systems by URI, so any store that it knows will do. A
file is named after its task attempt and told of only by rows that its task returned, so lost
or repeated attempts leave nothing but unread files.

Defined cases: null payload counts as empty; null URL has the key ``-``; rows with equal URL
and id are separate captures with equal answers; a table without rows gives no files and no
rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, new_path, sized_broadcast

#: Payloads of at least so many bytes are stored once; others are stored each time.
REVISIT_BYTES = 1000
#: Captures of an index block, and of an index part on average.
BLOCK_LINES, PART_LINES = 256, 200_000
#: Records that a task of a lookup reads on average.
TASK_LINES = 20_000
#: Hashes of repeated payloads that are broadcast at most.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host key: host labels from the top, then path and query, lower-case host, no scheme."""
    if not url:
        return "-"
    try:
        u = urlsplit(url)
        host, port = u.hostname or "", u.port
    except ValueError:
        return "-," + url.replace(" ", "%20").replace("\n", "%0A")
    rest = (u.path or "/") + ("?" + u.query if u.query else "")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return (name + ")" + rest).replace(" ", "%20").replace("\n", "%0A")


def capture_key(url: str | None, capture_id: int | None) -> str:
    """Key of one capture: URL key, then the id in a width that sorts as numbers do."""
    return f"{url_key(url)} {'-' if capture_id is None else format(capture_id + (1 << 63), '020d')}"


def open_path(path: str):
    """File system and inner path of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Ranges:
    """Byte-range reads of files, a few of which stay open."""

    def __init__(self):
        self.files: dict = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            store, inner = open_path(path)
            self.files[path] = store.open_input_file(inner)
        return self.files[path].read_at(length, offset)


def record(kind: str, url: str | None, capture_id: int | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head of the capture and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:capture:{'' if capture_id is None else capture_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:capture:{refers_to}>")
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of one record: type, id, url, digest (hex), payload length and bytes, refers_to.

    The payload of a response is checked against its digest and length.
    """
    raw = gzip.decompress(member)
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    number = lambda x: int(x[len("<urn:capture:") : -1]) if x and x != "<urn:capture:>" else None
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
    return {
        "type": fields["WARC-Type"],
        "id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "digest": digest.hex(),
        "length": length,
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "refers_to": number(fields.get("WARC-Refers-To", "")),
    }


def write_archive(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record a row; returns the captures (key, file, offset, length), stored.

    Which payloads repeat is found from digests alone; the response of a group is its largest
    id. Sha-1 and sha-256 both have to agree.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = read.withColumn("s1", F.unhex(F.sha1("payload"))).withColumn("s2", F.unhex(F.sha2("payload", 256)))
    large = keyed.where(F.length("payload") >= REVISIT_BYTES).groupBy("s1", "s2").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    repeated = materialize(large.where("n > 1").select("s1", "s2", "keeper"), "payloads")
    rows = keyed.join(sized_broadcast(repeated, repeated.count(), BROADCAST_ROWS), ["s1", "s2"], "left")
    rows = rows.select("id", "url", "payload", "s1", F.when(F.col("id") != F.col("keeper"), F.col("keeper")).alias("refers_to"))

    def run(frames):
        name, at, sink, out = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, None, []
        for pdf in frames:
            for i, url, payload, s1, refers in pdf.itertuples(index=False):
                i, refers = (None if pd.isna(x) else int(x) for x in (i, refers))
                member = record("response" if refers is None else "revisit", url, i, bytes(payload), bytes(s1), refers)
                if sink is None:
                    store, inner = open_path(name)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(inner, compression=None)
                sink.write(member)
                out.append((capture_key(url, i), name, at, len(member)))
                at += len(member)
        if sink is not None:
            sink.close()
            for k in range(0, len(out), 50_000):
                yield pd.DataFrame(out[k : k + 50_000], columns=["key", "file", "offset", "length"])

    # ids are passed as decimals of text: a null among longs would turn pandas' ids into floats
    safe = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "s1", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(safe.mapInPandas(run, "key string, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, folder: str | None = None, part_lines: int = PART_LINES) -> list[tuple[str, str, str, int]]:
    """Sort captures into compressed blocks; returns (first key, directory, blocks, lines) of each part.

    The list has a row a part of about ``part_lines`` captures, so it stays small: one in
    ``part_lines`` captures. The directory of a part has a row a block.
    """
    spark = captures.sparkSession
    folder = folder or new_path(spark, "index")
    parts = max(1, -(-captures.count() // part_lines))

    def run(frames):
        base = f"{folder}/cdx-{uuid.uuid4().hex}"
        sink, first, lines, total, at, directory = None, None, [], 0, 0, []

        def close_block():
            nonlocal at, lines
            packed = zlib.compress("\n".join(lines).encode())
            sink.write(packed)
            directory.append(f"{lines[0].rsplit(' ', 3)[0]} {at} {len(packed)}")
            at += len(packed)
            lines = []

        for pdf in frames:
            for key, file, offset, length in pdf.itertuples(index=False):
                if sink is None:
                    store, inner = open_path(base + ".blocks")
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink, first = store.open_output_stream(inner, compression=None), key
                lines.append(f"{key} {offset} {length} {file}")
                total += 1
                if len(lines) == BLOCK_LINES:
                    close_block()
        if sink is not None:
            if lines:
                close_block()
            sink.close()
            store, inner = open_path(base + ".directory")
            with store.open_output_stream(inner, compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pd.DataFrame([(first, base + ".directory", base + ".blocks", total)], columns=["first", "directory", "blocks", "lines"])

    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
    got = materialize(ordered.mapInPandas(run, "first string, directory string, blocks string, lines long"), "parts")
    return sorted(tuple(r) for r in got.collect())


class Index:
    """Binary search through parts, directory and blocks; the last of each is kept."""

    def __init__(self, parts: list[tuple[str, str, str, int]]):
        self.parts, self.firsts, self.ranges = parts, [p[0] for p in parts], Ranges()
        self.part = self.block = None

    def _directory(self, n: int) -> None:
        if self.part != n:
            store, inner = open_path(self.parts[n][1])
            with store.open_input_file(inner) as f:
                rows = [x.rsplit(" ", 2) for x in f.read().decode().split("\n")]
            self.part, self.block = n, None
            self.starts, self.where = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; equal keys may cross blocks and parts."""
        out: list[tuple[str, int, int]] = []
        n = bisect_right(self.firsts, key) - 1
        while n >= 0:
            self._directory(n)
            b = bisect_right(self.starts, key) - 1
            while b >= 0:
                if self.block != b:
                    rows = zlib.decompress(self.ranges.read(self.parts[n][2], *self.where[b])).decode().split("\n")
                    self.lines = [x.rsplit(" ", 3) for x in rows]
                    self.block = b
                keys = [x[0] for x in self.lines]
                end = bisect_right(keys, key)
                at = end
                while at and keys[at - 1] == key:
                    at -= 1
                out += [(x[3], int(x[1]), int(x[2])) for x in self.lines[at:end]]
                if at > 0:
                    return out
                b -= 1
            n -= 1
        return out


def lookup(wanted: DataFrame, parts: list[tuple[str, str, str, int]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Records of the captures named by URL and id: id, type, payload, its length and digest, refers_to.

    One row a wanted row, from the range it was found at; captures that the index lacks give no row.
    """
    schema = "id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def keys(frames):
        for pdf in frames:
            ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
            yield pd.DataFrame({"key": [capture_key(u, i) for u, i in zip(pdf["url"], ids)]})

    def run(frames):
        index, last, nth = Index(parts), None, 0
        for pdf in frames:
            rows, held = [], 0
            for key in pdf["key"]:
                if key != last:
                    last, nth, found = key, 0, index.find(key)
                if nth >= len(found):
                    nth += 1
                    continue
                r = parse(index.ranges.read(*found[nth]))
                nth += 1
                rows.append((r["id"], r["type"], r["payload"], r["length"], r["digest"], r["refers_to"]))
                held += len(r["payload"] or b"")
                if held > 8 << 20:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    safe = wanted.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"))
    key = safe.mapInPandas(keys, "key string")
    # equal keys stay in one task, so the n-th of them takes the n-th capture; keys are small beside
    # the records they stand for, so the number of tasks follows from the lines of the index
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-sum(p[3] for p in parts) // TASK_LINES))
    return key.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
    for c in ("id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out
