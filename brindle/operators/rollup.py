"""Slow-query logs to one row for each fingerprint, and pages of that result by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of the recency window in days, and fingerprints that an extraction returns.
DAYS, CAP = 15, 500


def latest(column: str, order: Column) -> Column:
    """The value at the latest time, null values left out."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))


#: What a fingerprint's latest execution gives: result column and log column.
LATEST = {
    "text": "sanitized_sql", "raw_query": "sample_sql", "source": "db", "tables": "tables", "user": "user", "host": "host",
    "rows_sent": "rows_sent", "rows_examined": "rows_examined", "lock_time_sec": "lock_time_sec",
}
RESULT = ["id", "text", "raw_query", "source", "execution_time_ms", "calls", "tables", "latest_ts", "user", "host", "rows_sent", "rows_examined", "lock_time_sec"]


def fingerprint_rollup(logs: DataFrame, as_of: Column, *, days: int = DAYS, cap: int | None = CAP, batch_id: str | None = None, tiebreak: str | None = None, within: str | None = None) -> DataFrame:
    """One row for each fingerprint of executions later than as_of - days, the costliest first.

    At equal times the row with the larger tiebreak column counts. batch_id keeps one batch of the log. within: a column
    whose values have rollups of their own, each with its cap."""
    # as a time of day, so that sources can take the filter
    rows = logs.where(F.col("ts") > F.date_sub(as_of, days).cast(logs.schema["ts"].dataType))
    if batch_id is not None:
        rows = rows.where(F.col("batch_id") == F.lit(batch_id))
    order = F.struct("ts", tiebreak) if tiebreak else F.col("ts")
    totals = [(F.sum("query_time_sec") * 1000).alias("execution_time_ms"), F.count(F.lit(1)).alias("calls"), F.max("ts").alias("latest_ts")]
    each = [within] if within else []
    out = rows.groupBy(*each, F.col("fingerprint_id").alias("id")).agg(*totals, *[latest(c, order).alias(a) for a, c in LATEST.items()])
    if within and cap:
        place = F.row_number().over(Window.partitionBy(within).orderBy(F.desc("execution_time_ms"), "id"))
        out, cap = out.withColumn("_place", place).where(F.col("_place") <= cap), None
    out = out.select(RESULT)
    ordered = out.orderBy(F.desc("execution_time_ms"), "id")
    return ordered.limit(cap) if cap else ordered


def keyset_page(rollup: DataFrame, limit: int, after: tuple[float, str] | None = None) -> DataFrame:
    """The next rows in order of falling time and rising id after a (time, id) cursor."""
    if after is not None:
        t, i = F.lit(after[0]), F.lit(after[1])
        rollup = rollup.where((F.col("execution_time_ms") < t) | ((F.col("execution_time_ms") == t) & (F.col("id") > i)))
    return rollup.orderBy(F.desc("execution_time_ms"), "id").limit(limit)
