"""Query records over HTTP as a Spark data source: format("httprecords"), for batches and streams.

A batch walks the pages of one server, or of each of its databases in a partition of its own. A stream's offset is the
server's cursor with the records of its page that were read, and the time since which records are asked for: what a
micro-batch reads between two offsets is read again as it was, and a restarted stream goes on behind the last one.
"""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from brindle.session import ship_package

log = logging.getLogger("brindle.http")
FIELDS = ("id", "text", "raw_query", "source", "execution_time_ms", "calls", "latest_ts", "user", "host", "rows_sent", "rows_examined", "lock_time_sec")
RECORDS = StructType([*(StructField(f, StringType()) for f in FIELDS), StructField("tables", ArrayType(StringType()))])


def since_literal(days: int, as_of: datetime | None = None) -> str:
    return ((as_of or datetime.now(timezone.utc)) - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _call(url: str, key: str, timeout: float, body: dict | None = None) -> dict:
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}) | ({"Content-Type": "application/json"} if body else {})
    request = urllib.request.Request(url, headers=headers, data=json.dumps(body).encode() if body else None)
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.loads(answer.read())


def _page(o: dict, cursor: str | None) -> tuple[list[dict], str | None]:
    """The records of a page, and the next one's cursor or None; a page that says there is more but gives no new cursor raises."""
    params = {"limit": o.get("page_size", "200"), "since": o.get("since") or since_literal(int(o.get("since_days", "15"))), "min_execution_ms": o.get("min_execution_ms", "0.0")}
    params |= ({"database": o["database"]} if o.get("database") else {}) | ({"cursor": cursor} if cursor else {})
    page = _call(f"{o['path'].rstrip('/')}/sql/queries?{urllib.parse.urlencode(params)}", o.get("api_key", ""), float(o.get("timeout_sec", "30")))
    after = page.get("next_cursor") if page.get("has_more") else None
    if page.get("has_more") and (not after or after == cursor):
        raise ValueError("the server says there is more but gives no new cursor")
    return page.get("data") or [], after


def pages(o: dict) -> Iterator[dict]:
    """Records of all pages, walked with one time since which they are asked for."""
    o = o | {"since": o.get("since") or since_literal(int(o.get("since_days", "15")))}
    seen, cursor = set(), None
    while True:
        data, cursor = _page(o, cursor)
        yield from data
        if cursor is None:
            return
        if cursor in seen:
            raise ValueError("the server gives a cursor again")
        seen.add(cursor)


def databases(o: dict) -> list[str]:
    return [str(x) for x in _call(f"{o['path'].rstrip('/')}/sql/databases", o.get("api_key", ""), float(o.get("timeout_sec", "30"))).get("databases") or []]


def custom(o: dict) -> Iterator[dict]:
    body = {"query": o["query"], "timeout_ms": int(float(o.get("timeout_sec", "30")) * 1000)} | ({"database": o["database"]} if o.get("database") else {})
    table = _call(f"{o['path'].rstrip('/')}/sql/execute", o.get("api_key", ""), float(o.get("timeout_sec", "30")), body)
    for row in table.get("rows") or []:
        yield dict(zip(table.get("columns") or [], row))


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def _row(r: dict) -> tuple:
    tables = r.get("tables")
    return (*(_text(r.get(f)) for f in FIELDS), [_text(t) for t in tables] if isinstance(tables, list) else [])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """One, as each page's cursor comes with the page before; with by_database one for each database."""
        o = self.options
        if o.get("by_database") == "true" and not o.get("query"):
            try:
                return [InputPartition(name) for name in databases(o)]
            except (urllib.error.URLError, OSError, ValueError) as e:
                if o.get("strict") == "true":
                    raise
                log.error("the databases can't be told: %s", e)
                return []
        return [InputPartition(None)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # there are none
            return
        o = self.options | ({"database": partition.value} if partition.value else {})
        try:
            for r in custom(o) if o.get("query") else pages(o):
                yield _row(r)
        except (urllib.error.URLError, OSError, ValueError) as e:
            if o.get("strict") == "true":
                raise
            log.error("the records end early: %s", e)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets: since, the page's cursor, and how many records of that page were read, as the last page may grow. Errors
    raise: the micro-batch is not done, and the restarted stream reads it again."""

    def __init__(self, options: dict):
        self.options, self.most = dict(options), int(options.get("pages_per_batch", "10"))

    def initialOffset(self) -> dict:  # noqa: N802
        o = self.options
        return {"since": o.get("since") or since_literal(int(o.get("since_days", "15"))), "cursor": None, "read": 0}

    def _walk(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        at, rows, turned = dict(start), [], 0
        while True:
            data, after = _page(self.options | {"since": at["since"]}, at["cursor"])
            ends = end is not None and end["cursor"] == at["cursor"]
            rows += map(_row, data[at["read"] : end["read"] if ends else None])
            turned += 1
            if ends:
                return rows, end
            if after is None or (end is None and turned == self.most):
                if after is None:
                    return rows, at | {"read": max(len(data), at["read"])}
                return rows, at | {"cursor": after, "read": 0}
            at |= {"cursor": after, "read": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._walk(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._walk(start, end)[0])


class HttpRecordSource(DataSource):
    """Options: path (base URL), api_key, page_size, since, since_days, min_execution_ms, database, by_database, timeout_sec, query, strict; of streams pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "httprecords"

    def schema(self) -> StructType:
        return RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read_http(spark: SparkSession, base_url: str, **options) -> DataFrame:
    """Records of a server, all fields text; an error ends the rows with a log message, or raises with strict="true"."""
    ship_package(spark)
    spark.dataSource.register(HttpRecordSource)
    reader = spark.read.format("httprecords")
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(base_url)


def stream_http(spark: SparkSession, base_url: str, **options) -> DataFrame:
    """The same records as a stream, pages_per_batch pages in a micro-batch."""
    ship_package(spark)
    spark.dataSource.register(HttpRecordSource)
    reader = spark.readStream.format("httprecords")
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(base_url)
