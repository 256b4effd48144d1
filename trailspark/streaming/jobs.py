"""Structured Streaming forms of the same rules: ingest, alerts, activity windows, relay detection.

Streams run with ``availableNow`` in tests and with any trigger in service. Ingest and activity hold
no state and take rows of any age; the state of :func:`relays` is bounded by a watermark. Sources have
to give ``timestamp`` columns: a watermark on a timestamp without time zone is an error, so
:func:`typed` casts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import KEY, backfill, first_write


def typed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """``stream`` with its event time as a timestamp."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, table: str, checkpoint: str):
    """Start a query that appends new movements to ``table``, however late: the first by time of a
    micro-batch's equal keys, unless the table has the key. Null keys equal null keys."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = old.getFileSystem(spark._jsc.hadoopConfiguration()).exists(old)
        rows = first_write(batch, ["ts"]).select(*batch.columns)
        if there:
            stored = spark.read.schema(batch.schema).parquet(table).select(*[F.col(k).alias(f"_{k}") for k in KEY])
            rows = rows.join(stored, [rows[k].eqNullSafe(stored[f"_{k}"]) for k in KEY], "left_anti")
        rows.write.mode("append").parquet(table)

    return typed(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def late_prices(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """A micro-batch of gas prices applied once to stored movements."""
    return backfill(stored, batch, ["chain", "tx_hash"])


def alerts(stream: DataFrame, labels: DataFrame, category: str = "sanctioned") -> DataFrame:
    """Movements that touch an address of a category; the label side is read again each micro-batch."""
    hit = labels.where((F.col("status") == "active") & (F.col("category") == category)).select("chain", F.col("address").alias("hit")).distinct()
    ends = stream.select("*", F.explode(F.array_distinct(F.array("from_addr", "to_addr"))).alias("hit"))
    return ends.join(hit, ["chain", "hit"])


def activity(stream: DataFrame, table: str, checkpoint: str, key: str = "address", other: str = "other", size: str = "6 hours", slide: str = "1 hour"):
    """Start a query that adds each micro-batch's counts by ``key`` and sliding window to ``table``.

    Counts and sketches of counterparts add up over micro-batches (:func:`activity_read`), so no
    row is too late and no state is held; a repeated micro-batch replaces its own part.
    """

    def write(batch: DataFrame, n: int) -> None:
        part = batch.groupBy(F.window("ts", size, slide), key).agg(F.hll_sketch_agg(other).alias("others"), F.count("*").alias("n"))
        part.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return typed(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def activity_read(spark: SparkSession, table: str, key: str = "address") -> DataFrame:
    """(window, key, others, n) of all micro-batches; the distinct counts are approximate."""
    return spark.read.parquet(table).groupBy("window", key).agg(F.hll_sketch_estimate(F.hll_union_agg("others")).alias("others"), F.sum("n").alias("n"))


def event_tail(stream: DataFrame, after: int = 0) -> DataFrame:
    """Label events past a cursor as they are appended."""
    return stream.where(F.col("id") > after)


def relay_processor(width_s: int = 1800):
    """A stateful processor for ``transformWithStateInPandas`` keyed by (address, asset).

    Receipts wait in list state until a send of the asset takes the earliest one within
    ``width_s``; an event-time timer drops receipts that nothing can take any more.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Relay(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "us long")

        def _keep(self, times: list[int]) -> None:
            self.waiting.put([(t,) for t in times]) if times else self.waiting.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            wait = sorted(int(r[0]) for r in self.waiting.get()) if self.waiting.exists() else []
            got = pd.concat(list(rows)).sort_values(["us", "side"])
            out = []
            for us, side in zip(got["us"].tolist(), got["side"].tolist()):
                wait = [t for t in wait if us - t <= width_s * 1_000_000]
                if side == "in":
                    wait.append(us)
                elif wait:
                    out.append((*key, wait.pop(0), us))
            self._keep(wait)
            if wait:
                self.handle.registerTimer(wait[0] // 1000 + width_s * 1000)
            yield pd.DataFrame(out, columns=["address", "asset", "in_us", "out_us"])

        def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
            now = expired_timer_info.get_expiry_time_in_ms() * 1000
            wait = sorted(int(r[0]) for r in self.waiting.get()) if self.waiting.exists() else []
            self._keep([t for t in wait if now - t < width_s * 1_000_000])
            yield pd.DataFrame([], columns=["address", "asset", "in_us", "out_us"])

        def close(self) -> None:
            pass

    return Relay()


RELAY_SCHEMA = "address string, asset string, in_us long, out_us long"


def relays(stream: DataFrame, width_s: int = 1800, late: str = "1 hour") -> DataFrame:
    """Relayed pairs as events arrive; rows later than the watermark are dropped by Spark."""
    rows = typed(stream).withWatermark("ts", late).select("address", "asset", "side", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("address", "asset").transformWithStateInPandas(relay_processor(width_s), RELAY_SCHEMA, "append", "EventTime")
