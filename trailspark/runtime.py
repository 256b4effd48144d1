"""Shared run-time helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Tables of materialize() by the identity of their frames, which are kept here so that it stays theirs.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local master (tests) gets a temporary folder of this process,
    removed at exit; on a cluster executors would not see it, so there it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-trail-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it is deleted when the driver's Python exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; the folder then stays for its owner
        pass


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``compression`` is the session's unless told.

    Lineage is cut by a table that outlives any executor; row counts of it come from file
    footers. The table is deleted when the driver's Python exits.
    """
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    _PATHS[id(stored)] = (stored, path)
    return stored


def release(stored: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    _, path = _PATHS.pop(id(stored), (None, None))
    if path:
        _delete(stored.sparkSession, path)


#: Rows of the largest input table for each partition that a shuffle starts with.
PARTITION_ROWS = 200_000
#: Bytes of compressed shuffle rows that one task takes; sorted and grouped in memory they are some twenty times as many.
TASK_BYTES = 16 << 20
#: Inputs up to so many rows keep the session's own settings where its partitions are enough: all they shuffle is a few times TASK_BYTES.
FEW_ROWS = 1_000_000
#: What fit_partitions() changed: settings as they were before, by session.
_FITTED: dict[str, dict[str, str | None]] = {}


def fit_partitions(spark: SparkSession, rows: int) -> None:
    """Let shuffles start with a partition for every ``PARTITION_ROWS`` of ``rows`` and tasks take ``TASK_BYTES``, for this session.

    A fixed number of partitions makes each task's sorts and tables grow with the input until they
    spill. A session whose own number is enough keeps it, but adaptive execution would join its
    partitions to the session's size of a task, so that size is bounded too unless rows are few; a
    session's smaller size stays.
    """
    before = _FITTED.pop(spark.sparkContext.applicationId, {})
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    most, size = -(-rows // PARTITION_ROWS), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = {}
    if most > int(spark.conf.get("spark.sql.shuffle.partitions")):
        wanted["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(most)
    if wanted or rows > FEW_ROWS:
        own_size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
        wanted[size] = str(min(TASK_BYTES, own_size))
    _FITTED[spark.sparkContext.applicationId] = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most about ``size`` bytes for the jobs that run inside; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of keys that are broadcast, at most: some hundred bytes each in memory.
SMALL_ROWS = 1 << 20


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` are within ``limit``, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of an id written as decimal text; null ids count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
