"""Continuous ingest and rollups on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.records import from_log_records
from brindle.plans.schema import RECORD


def watch_records(spark: SparkSession, folder: str, run_ts: str) -> DataFrame:
    """SQL chunks of JSON-lines files as they arrive in a folder."""
    return from_log_records(spark.readStream.schema(RECORD).json(folder), F.lit(run_ts))


def into_vault(chunks: DataFrame, write_batch, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hand each micro-batch to write_batch(df, epoch), such as one that anti-joins, embeds and appends."""
    writer = chunks.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_rollup(logs: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Time and calls of each fingerprint in each window of event time (ts, timestamp); rows later than the watermark are dropped."""
    return (
        logs.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "fingerprint_id")
        .agg((F.sum("query_time_sec") * 1000).alias("execution_time_ms"), F.count(F.lit(1)).alias("calls"))
        .select(F.col("w.start").alias("window_start"), "fingerprint_id", "execution_time_ms", "calls")
    )
