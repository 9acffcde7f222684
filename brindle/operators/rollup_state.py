"""Rollups kept as partial aggregates that merge, and rollups stored in the order of their pages.

A partial is one row for each day, batch and fingerprint: sums and counts add up, and of each column that shows the latest
value the pair (time, value) stays, whose maximum is the maximum of maxima. So logs may come in any order, late rows
included, and the rollup of a window is a merge of its days' partials that reads no log. Partials lie in segments
under a versioned manifest, as a vault's rows do: an ingest key counts once, and compaction merges segments.
"""

from __future__ import annotations

import base64
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.rollup import CAP, DAYS, LATEST, RESULT
from brindle.operators.store import Manifests
from brindle.session import remove

KEYS = ["day", "batch_id", "fingerprint_id"]
#: Segments above which partials are merged.
MOST_PARTS = 16


def partials(logs: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """One row for each day, batch_id and fingerprint_id of logs. A day ends with the instant of midnight, as windows begin after one."""
    if "batch_id" not in logs.columns:
        logs = logs.withColumn("batch_id", F.lit(None).cast("string"))
    tie = F.col(tiebreak) if tiebreak else F.lit(0)
    pair = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("ts").alias("at"), tie.cast("long").alias("tie"), F.col(c).alias("value"))))
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 0.000001 SECOND")).alias("day")
    totals = [F.sum("query_time_sec").alias("seconds"), F.count(F.lit(1)).alias("calls"), F.max("ts").alias("latest_ts")]
    return logs.where(F.col("ts").isNotNull()).groupBy(day, "batch_id", "fingerprint_id").agg(*totals, *[pair(c).alias(a) for a, c in LATEST.items()])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of the same keys as one."""
    totals = [F.sum("seconds").alias("seconds"), F.sum("calls").alias("calls"), F.max("latest_ts").alias("latest_ts")]
    return parts.groupBy(*keys).agg(*totals, *[F.max(a).alias(a) for a in LATEST])


def rollup_of(parts: DataFrame, as_of: Column, *, days: int = DAYS, cap: int | None = CAP, batch_id: str | None = None) -> DataFrame:
    """What fingerprint_rollup() gives of the logs, from their partials."""
    rows = parts.where(F.col("day") >= F.date_sub(as_of, days))
    if batch_id is not None:
        rows = rows.where(F.col("batch_id") == F.lit(batch_id))
    out = merged(rows, ["fingerprint_id"]).select(
        F.col("fingerprint_id").alias("id"), (F.col("seconds") * 1000).alias("execution_time_ms"), "calls", "latest_ts", *[F.col(f"{a}.value").alias(a) for a in LATEST]
    )
    ordered = out.select(RESULT).orderBy(F.desc("execution_time_ms"), "id")
    return ordered.limit(cap) if cap else ordered


class RollupState:
    """Partials at a path, for logs with one set of columns."""

    def __init__(self, spark: SparkSession, path: str, tiebreak: str | None = None):
        self.spark, self.path, self.tiebreak = spark, path.rstrip("/"), tiebreak
        self.manifests = Manifests(spark, f"{self.path}/manifests")

    def _held(self) -> list[str]:
        return [s["name"] for s in (self.manifests.load() or {"segments": []})["segments"]]

    def read(self) -> DataFrame | None:
        names = self._held()
        return self.spark.read.parquet(*(f"{self.path}/parts/{n}" for n in names)) if names else None

    def _write(self, parts: DataFrame) -> str:
        name = f"p-{uuid.uuid4().hex}"
        # a window reads the row groups of its days
        parts.sortWithinPartitions("day").write.parquet(f"{self.path}/parts/{name}")
        return name

    def add(self, logs: DataFrame, *, ingest: str | None = None) -> bool:
        """Fold logs in: False where the ingest key has been before."""
        state = self.manifests.load()
        if state and ingest is not None and ingest in state["ingests"]:
            return False
        name = self._write(partials(logs, self.tiebreak))

        def change(s: dict) -> dict | None:
            if ingest is not None and ingest in s["ingests"]:
                return None
            s["segments"].append({"name": name})
            s["ingests"] += [ingest] if ingest is not None else []
            return s

        held = name in (s["name"] for s in self.manifests.commit(change)["segments"])
        if not held:
            remove(self.spark, f"{self.path}/parts/{name}")
        elif len(self._held()) > MOST_PARTS:
            self.compact()
        return held

    def compact(self) -> None:
        """All partials of a day, batch and fingerprint as one; replaced files stay for readers of older manifests."""
        names = self._held()
        if len(names) < 2:
            return
        one = self._write(merged(self.spark.read.parquet(*(f"{self.path}/parts/{n}" for n in names)), KEYS))

        def change(s: dict) -> dict | None:
            if not set(names) <= {x["name"] for x in s["segments"]}:
                return None
            return s | {"segments": [{"name": one}] + [x for x in s["segments"] if x["name"] not in names]}

        self.manifests.commit(change)

    def rollup(self, as_of: Column, **how) -> DataFrame:
        parts = self.read()
        if parts is None:
            raise ValueError(f"{self.path} holds no partials")
        return rollup_of(parts, as_of, **how)

    def follow(self, logs: DataFrame, checkpoint: str, *, name: str = "stream", once: bool = False) -> StreamingQuery:
        """Fold a stream in, each micro-batch once, however often it is tried; rows of any age count."""
        writer = logs.writeStream.foreachBatch(lambda batch, number: self.add(batch, ingest=f"{name}-{number}") and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


# ---- pages ---------------------------------------------------------------------------------------------------------------

PAGE_ROWS = 50_000


def store_pages(rollup: DataFrame, path: str, rows_per_file: int = PAGE_ROWS) -> None:
    """Write a rollup to path, which must be new, in the order of falling time and rising id, ranges of it in files, with each file's first and last key."""
    spark = rollup.sparkSession
    rollup.write.parquet(f"{path}/given")  # ranges are told from a sample, which shall not run the rollup again
    rows = spark.read.parquet(f"{path}/given")
    files = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(files, F.desc("execution_time_ms"), F.asc("id")).sortWithinPartitions(F.desc("execution_time_ms"), "id").write.parquet(f"{path}/rows")
    remove(spark, f"{path}/given")
    key = F.struct((-F.col("execution_time_ms")).alias("t"), "id")
    facts = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    facts.coalesce(1).write.parquet(f"{path}/files")


def cursor_of(time: float, id_: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([time, id_]).encode()).decode()


def read_cursor(cursor: str) -> tuple[float, str]:
    try:
        time, id_ = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return float(time), str(id_)
    except ValueError as e:
        raise ValueError("this is no cursor") from e


def seek_page(spark: SparkSession, path: str, limit: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(the next ``limit`` rows after a cursor, the cursor after them or None at the end). No more files are read than hold these rows and the one behind them."""
    files = spark.read.parquet(f"{path}/files")
    if cursor is not None:
        time, id_ = read_cursor(cursor)
        after = F.struct(F.lit(-time).alias("t"), F.lit(id_).alias("id"))
        files = files.where(F.col("last") > after)
    near = files.orderBy("first").limit(limit + 2).collect()  # each holds a row at least, and all but the first only rows behind the cursor
    if not near:
        return spark.read.parquet(f"{path}/rows").limit(0), None
    upto = 1
    while True:
        rows = spark.read.parquet(*(f"{path}/rows/{r.file}" for r in near[:upto]))
        rows = (_after(rows, cursor) if cursor is not None else rows).orderBy(F.desc("execution_time_ms"), "id")
        found = rows.select("execution_time_ms", "id").limit(limit + 1).collect()
        if len(found) > limit or upto == len(near):
            break
        held = len(found)
        while held <= limit and upto < len(near):
            held, upto = held + near[upto].n, upto + 1
    return rows.limit(limit), cursor_of(found[limit - 1].execution_time_ms, found[limit - 1].id) if len(found) > limit else None


def _after(rows: DataFrame, cursor: str) -> DataFrame:
    time, id_ = read_cursor(cursor)
    t = F.col("execution_time_ms")
    return rows.where((t < time) | ((t == time) & (F.col("id") > id_)))
