"""Table layouts of the two kinds of vaults, and of records and results."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()
_VECTOR = T.ArrayType(T.FloatType(), False)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v[0] if isinstance(v, tuple) else v, not (isinstance(v, tuple))) for k, v in fields.items()])


DOCUMENT = _struct(filepath=(_S,), content=(_S,), content_hash=(_S,))
CHUNK = _struct(id=(_S,), text=(_S,), source=(_S,), content_hash=(_S,), node_type=_S, parent_scope=_S, line_range=_S)
SQL_CHUNK = _struct(
    id=(_S,), text=(_S,), raw_query=_S, source=(_S,), execution_time_ms=_D, calls=_L, content_hash=(_S,), tables=T.ArrayType(_S), latest_ts=T.TimestampNTZType(),
    user=_S, host=_S, rows_sent=_L, rows_examined=_L, lock_time_sec=_D,
)
DOCUMENT_VAULT = _struct(id=(_S,), vector=(_VECTOR,), text=(_S,), source=(_S,), content_hash=(_S,), workflow=(_S,), node_type=_S, parent_scope=_S, line_range=_S)
SQL_VAULT = _struct(
    id=(_S,), vector=(_VECTOR,), text=(_S,), raw_query=_S, source=(_S,), execution_time_ms=_D, calls=_L, content_hash=(_S,), workflow=(_S,), tables=T.ArrayType(_S),
    latest_ts=T.TimestampNTZType(), user=_S, host=_S, rows_sent=_L, rows_examined=_L, lock_time_sec=_D,
)
VAULTS = {"document": DOCUMENT_VAULT, "sql": SQL_VAULT}
#: Columns of a record before projection; all text, so that one projection serves every source.
RECORD_FIELDS = ("query", "normalized_query", "normalized", "query_hash", "id", "database", "source", "duration", "execution_time_ms", "calls", "latest_ts", "user", "host", "rows_sent", "rows_examined", "lock_time_sec")
RECORD = T.StructType([*(T.StructField(k, _S) for k in RECORD_FIELDS), T.StructField("tables", T.ArrayType(_S))])
#: One row for each execution in a slow-query log.
SLOW_LOG = T.StructType([
    T.StructField("id", _L), T.StructField("file_hash", _S), T.StructField("fingerprint_id", _S), T.StructField("sanitized_sql", _S), T.StructField("sample_sql", _S), T.StructField("db", _S),
    T.StructField("query_time_sec", _D), T.StructField("ts", T.TimestampNTZType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("tables", T.ArrayType(_S)),
    T.StructField("user", _S), T.StructField("host", _S), T.StructField("rows_sent", _L), T.StructField("rows_examined", _L), T.StructField("lock_time_sec", _D),
])
