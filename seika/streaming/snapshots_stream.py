"""Monitoring snapshots (M5) from a live request-event stream.

Every micro-batch counts its own events per 5-minute tick and writes these
partial counts to a folder of its own, named by the stream and the batch: a
replayed batch replaces its folder. Partial counts add up, so an event that
arrives late, however late, still counts in its tick; the stream keeps no
state and needs no watermark. Snapshots with running totals are a batch read
over the partial counts (``monitor.snapshots_from_ticks``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seika.functions.dates import instant_as_utc_ntz, ntz_as_utc_instant
from seika.operators import monitor as M

TICKS = "monitor_ticks"


def _ticks_path(table_root: str) -> str:
    return f"{table_root.rstrip('/')}/{TICKS}"


def start_snapshot_stream(spark: SparkSession, requests: DataFrame, table_root: str, checkpoint: str,
                          available_now: bool = True):
    """``requests`` is a streaming request log (ts, method, path, status,
    seconds). Returns the ``StreamingQuery``."""
    if dict(requests.dtypes)["ts"] == "timestamp_ntz":
        requests = requests.withColumn("ts", ntz_as_utc_instant("ts"))  # NTZ wall times are read as UTC
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:10]

    def add(batch: DataFrame, batch_id: int) -> None:
        ticks = M.tick_counts(batch).withColumn("tick_end", instant_as_utc_ntz("tick_end"))
        ticks.write.mode("overwrite").parquet(f"{_ticks_path(table_root)}/batch={stream}-{batch_id}")

    w = requests.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def ticks(spark: SparkSession, table_root: str) -> DataFrame:
    """The tick table: partial counts of all batches added up."""
    parts = spark.read.parquet(_ticks_path(table_root)).drop("batch")
    sums = [F.sum(c).cast("bigint").alias(c) for c in parts.columns if c not in ("tick_end", "ready_failed")]
    return parts.groupBy("tick_end").agg(F.max("ready_failed").alias("ready_failed"), *sums)


def snapshots(spark: SparkSession, table_root: str, runs: DataFrame | None = None) -> DataFrame:
    """M5 rows from the stored tick counts."""
    return M.snapshots_from_ticks(ticks(spark, table_root), runs)

