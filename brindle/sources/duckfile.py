"""Embedded analytical files as a Spark data source: format("duckfile").

Tasks open the files, to tell their columns and sizes as well as to read them, so that a plan over any number of files
with the same columns is one scan. Only the columns asked for are read, and filters on columns named as ``pushable`` are
put to each file's own engine. Spark 4.1 goes on using, for every later plan over one load, what the first plan's
filters left, so only columns may be named whose filters are the same in all plans, such as a rollup's own window.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.types import StringType, StructType

from brindle.operators.rollup import LATEST, fingerprint_rollup
from brindle.session import ship_package

log = logging.getLogger("brindle.duckfile")
#: Rows of a table that one partition reads; its files part rows into groups of 122,880, so ranges cover whole groups.
RANGE = 8 * 122_880
BATCH = 10_000
#: The column that says which file a row is from.
PATH = "_path"
_COMPARED = {EqualTo: "=", EqualNullSafe: "IS NOT DISTINCT FROM", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _connect(path: str):
    import duckdb

    con = duckdb.connect(path, read_only=True)
    con.execute("SET timezone = 'UTC'")
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _condition(f: Filter) -> tuple[str, list] | None:
    """A filter in the file's own SQL with its values, or None where it is left to Spark."""
    column = getattr(f, "attribute", ())
    if len(column) != 1:
        return None
    name = _quoted(column[0])
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    if isinstance(f, IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, StringStartsWith):
        return f"starts_with({name}, ?)", [f.value]
    if isinstance(f, In):
        return (f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)) if f.value and None not in f.value else None
    if type(f) in _COMPARED:
        return f"{name} {_COMPARED[type(f)]} ?", [f.value]
    return None


@dataclass
class _Part(InputPartition):
    path: str
    sql: str
    values: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.files, self.table, self.query, self.schema = json.loads(options["files"]), options.get("table"), options.get("query"), schema
        self.pushable = set(json.loads(options.get("pushable", "[]")))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            found = _condition(f) if getattr(f, "attribute", ("",))[0] in self.pushable else None
            if found is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def partitions(self) -> list[InputPartition]:
        """A table is read in ranges of its row numbers; a query of the user's own is one partition for each file."""
        columns = ", ".join(_quoted(c) for c in self.schema.names if c != PATH) or "NULL"
        inner = f"({self.query})" if self.query else _quoted(self.table)
        out: list[InputPartition] = []
        for path, last in self.files:
            ranges = [[]] if self.query else [[f"rowid >= {a} AND rowid < {a + RANGE}"] for a in range(0, (-1 if last is None else last) + 1, RANGE)]
            for r in ranges:
                where = " AND ".join(r + self.where)
                out.append(_Part(path, f"SELECT {columns} FROM {inner}" + (f" WHERE {where}" if where else ""), self.values))
        return out

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        con = _connect(partition.path)
        try:
            for batch in con.sql(partition.sql, params=partition.values).to_arrow_reader(BATCH):
                rows = pa.Table.from_batches([batch])
                if PATH in target.names:
                    rows = rows.append_column(PATH, pa.array([partition.path] * rows.num_rows, pa.string()))
                yield from rows.select(target.names).cast(target).to_batches()
        finally:
            con.close()


class DuckFileSource(DataSource):
    """Options: files (JSON pairs of a path and its table's last row number), table or query, and pushable (JSON list of columns). The schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "duckfile"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def _told(paths: list[str], table: str | None, query: str | None, columns: list[str] | None) -> Iterator[tuple]:
    """(path, schema as JSON, last row number, error) of each file."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    for path in paths:
        try:
            con = _connect(path)
            try:
                inner = f"({query})" if query else _quoted(table)
                empty = con.sql(f"SELECT {', '.join(map(_quoted, columns)) if columns else '*'} FROM {inner} LIMIT 0").to_arrow_table()
                last = None if query else con.execute(f"SELECT max(rowid) FROM {_quoted(table)}").fetchone()[0]
            finally:
                con.close()
            # unsigned integers become longs; one that does not fit stops the scan
            fields = [f.with_type(pa.int64()) if pa.types.is_unsigned_integer(f.type) else f for f in empty.schema]
            yield path, from_arrow_schema(pa.schema(fields), prefer_timestamp_ntz=True).json(), last, None
        except Exception as e:  # noqa: BLE001  (whatever is wrong with one file is told and does not end the others)
            yield path, None, None, f"{type(e).__name__}: {e}"


def scan(spark: SparkSession, paths: list[str], *, table: str | None = None, query: str | None = None, columns: list[str] | None = None, skip_broken: bool = False, with_path: bool = False,
         pushable: tuple[str, ...] = ()) -> DataFrame | None:
    """The rows of a table or of a query of several files, one scan for each set of columns among them; missing columns are null.

    A file that can't be opened or queried raises, or is logged and left out with skip_broken; None if none is left.
    Executors must see the paths. with_path adds the column PATH. pushable: see above."""
    ship_package(spark)
    spark.dataSource.register(DuckFileSource)
    # without it Spark refuses sources that take filters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    query = query.rstrip().rstrip(";") if query else None

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame(list(_told(pdf["path"].tolist(), table, query, columns)), columns=["path", "columns", "last", "error"]).astype({"last": "Int64"})

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths) // 16 + 1)
    found = listed.mapInPandas(run, "path string, columns string, last long, error string").collect() if paths else []  # a row for each file
    groups: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r.path):
        if r.error is None:
            groups.setdefault(r.columns, []).append((r.path, r.last))
        elif skip_broken:
            log.error("%s can't be queried: %s", r.path, r.error)
        else:
            raise ValueError(f"{r.path} can't be queried: {r.error}")
    out = None
    for columns_, files in groups.items():
        schema = StructType.fromJson(json.loads(columns_))
        reader = spark.read.format("duckfile").schema(schema.add(PATH, StringType()) if with_path else schema).option("files", json.dumps(files)).option("pushable", json.dumps(pushable))
        one = (reader.option("query", query) if query else reader.option("table", table)).load()
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_table(spark: SparkSession, paths: str | list[str], table: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a table of one file or of several, in several partitions; executors must see the paths."""
    return scan(spark, [paths] if isinstance(paths, str) else paths, table=table, columns=columns)


def read_duckfile(spark: SparkSession, paths: str | list[str], query: str | None = None, *, as_of: str | None = None, per_file: bool = False, skip_broken: bool = False, **how) -> DataFrame | None:
    """The rows of a query on the files; by default their slow_logs tables rolled up by fingerprint, to which ``how`` applies.

    per_file: each file's log has a rollup of its own. The window and the batch are told by the files' own engines."""
    paths = [paths] if isinstance(paths, str) else paths
    if query:
        return scan(spark, paths, query=query, skip_broken=skip_broken)
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    columns = ["fingerprint_id", "query_time_sec", "ts", *LATEST.values()] + (["batch_id"] if how.get("batch_id") is not None else []) + ([how["tiebreak"]] if how.get("tiebreak") else [])
    rows = scan(spark, paths, table="slow_logs", columns=columns, skip_broken=skip_broken, with_path=per_file, pushable=("ts", "batch_id"))
    return None if rows is None else fingerprint_rollup(rows, day, within=PATH if per_file else None, **how)
