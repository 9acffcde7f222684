"""Query records to SQL chunks: one projection for JSON exports, HTTP payloads and analytical files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.scalars import content_hash, first_of, nz_num, query_id, strip, to_double, to_long, to_utc
from brindle.plans.schema import RECORD

_OPTIONAL = ("user", "host")


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def project_sql_chunks(df: DataFrame, run_ts: Column) -> DataFrame:
    """Rows with id, text and source, and any of the other fields, to the SQL chunk layout; missing fields take their defaults.

    A run has one run_ts, which stands in for timestamps that are missing or can't be read."""
    text = _col(df, "text")
    calls = to_long(_col(df, "calls"))
    time = to_double(_col(df, "execution_time_ms"))
    tables = F.coalesce(F.col("tables").cast("array<string>"), F.array().cast("array<string>")) if "tables" in df.columns else F.array().cast("array<string>")
    return df.select(
        _col(df, "id").alias("id"), text.alias("text"), F.coalesce(_col(df, "raw_query"), F.lit("")).alias("raw_query"), _col(df, "source").alias("source"),
        F.coalesce(time, F.lit(0.0)).alias("execution_time_ms"), F.coalesce(nz_num(calls), F.lit(1).cast("bigint")).alias("calls"), content_hash(text).alias("content_hash"),
        tables.alias("tables"), to_utc(_col(df, "latest_ts"), run_ts).alias("latest_ts"), _col(df, "user").alias("user"), _col(df, "host").alias("host"),
        to_long(_col(df, "rows_sent")).alias("rows_sent"), to_long(_col(df, "rows_examined")).alias("rows_examined"), to_double(_col(df, "lock_time_sec")).alias("lock_time_sec"),
    )


def with_required(df: DataFrame) -> DataFrame:
    """Rows that have an id, a text and a source."""
    return df.dropna(subset=["id", "text", "source"])


def from_log_records(records: DataFrame, run_ts: Column) -> DataFrame:
    """Exported log records (all fields text, with their aliases) to SQL chunks; a record without a query text is skipped."""
    raw = F.coalesce(_col(records, "query"), F.lit(""))
    time = F.coalesce(nz_num(to_double(_col(records, "duration"))), nz_num(to_double(_col(records, "execution_time_ms"))), F.lit(0.0))
    keep = [c for c in ("calls", "tables", "latest_ts", *_OPTIONAL, "rows_sent", "rows_examined", "lock_time_sec") if c in records.columns]
    named = records.select(
        query_id(_col(records, "query_hash"), _col(records, "id"), raw).alias("id"), F.coalesce(first_of(_col(records, "normalized_query"), _col(records, "normalized")), raw).alias("text"),
        raw.alias("raw_query"), F.coalesce(first_of(_col(records, "database"), _col(records, "source")), F.lit("unknown")).alias("source"), time.alias("execution_time_ms"), *keep,
    )
    return project_sql_chunks(named.where(strip(F.col("text")) != ""), run_ts)


def parse_json_arrays(files: DataFrame) -> DataFrame:
    """Records of files (filepath, content) that hold one JSON array of objects each; other contents give no rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RECORD)
    valid = files.where(F.json_array_length("content").isNotNull())
    rows = valid.select("filepath", F.explode(F.from_json("content", f"array<struct<{fields.replace('` ', '`: ')}>>", {"mode": "PERMISSIVE"})).alias("r"))
    return rows.where("r is not null").select("filepath", "r.*")
