"""Vaults: tables of chunks with vectors, made of segments that a versioned manifest names.

Below a vault's folder: ``manifests`` has one small file for each version, ``rows`` a folder of Parquet files for each
segment, ``hashes`` the content hashes of each segment in buckets, and ``index`` what is built over segments. A segment
or an index is written whole before a manifest names it, and a manifest comes into being by one rename, so that a reader
sees one version or the next and a failure in between leaves the last one. An ingest's key stands in the manifest beside
its rows: an ingest that is repeated under its key adds nothing, and one that was ended before its manifest left nothing
that anyone reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from brindle.plans.schema import VAULTS
from brindle.session import remove

#: Seconds for which what a version alone names stays after a newer one took its place.
RETAIN = 3600
#: Buckets of content hashes; a vault keeps the number that it was made with.
HASH_BUCKETS = 16
#: Segments above which small ones are merged.
MOST_SEGMENTS = 8
# a row's key: the segment's place in the manifest, the file's task and part numbers, and the row's place in the file
PLACE, _TASK, _PART, _ROW = 1 << 56, 1 << 36, 1 << 28, 1 << 28


class SchemaMismatch(ValueError):
    """The stored table has other columns; it must be rebuilt."""


def _shape(s: StructType) -> list[list[str]]:
    return [[f.name, f.dataType.simpleString()] for f in s]


class Manifests:
    """Versions of a small JSON state: the newest counts, and a new one replaces the one that it was made from or fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self, p: str):
        path = self._hadoop.Path(p)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list:
        path, fs = self._fs(folder)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def load(self) -> dict | None:
        names = sorted(n for s in self.listed(self.path) if (n := s.getPath().getName()).startswith("v-"))
        if not names:
            return None
        path, fs = self._fs(f"{self.path}/{names[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, change: Callable[[dict], dict | None], tries: int = 8) -> dict:
        """change gets a copy of the newest state and gives the next, or None for none; it is called again where another writer came first."""
        for _ in range(tries):
            old = self.load() or {"version": 0, "segments": [], "ingests": []}
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old
            new["version"] = old["version"] + 1
            if self._put(new):
                return new
        raise RuntimeError(f"{self.path}: other writers came first {tries} times")

    def _put(self, state: dict) -> bool:
        aside, fs = self._fs(f"{self.path}/aside-{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        target = self._fs(f"{self.path}/v-{state['version']:012d}")[0]
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, plain)
        except Py4JJavaError:
            fs.delete(aside, False)
            if fs.exists(target):
                return False
            raise
        return True


def row_key(place: int = 0) -> Column:
    """The address of a row among those that are read: its segment's place, its file and its place there, as one number."""
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return F.lit(place * PLACE) + number(r"^part-(\d+)-") * F.lit(_TASK) + number(r"-c(\d+)\.") * F.lit(_PART) + F.col("_metadata.row_index")


class Vault:
    def __init__(self, spark: SparkSession, path: str, kind: str, dim: int, *, hash_buckets: int = HASH_BUCKETS):
        self.spark, self.path, self.kind, self.dim, self.schema = spark, path.rstrip("/"), kind, dim, VAULTS[kind]
        self.manifests = Manifests(spark, f"{self.path}/manifests")
        state = self.manifests.load()
        if state is None:
            state = self.manifests.commit(lambda s: s | {"kind": kind, "dim": dim, "columns": _shape(self.schema), "hash_buckets": hash_buckets})
        if state["columns"] != _shape(self.schema):
            raise SchemaMismatch(f"{self.path} has other columns than a {kind} vault; rebuild it")
        if state["dim"] != dim:
            if state["segments"]:
                raise SchemaMismatch(f"{self.path} holds vectors of {state['dim']} components, not {dim}; rebuild it")
            self.manifests.commit(lambda s: s | {"dim": dim})
        self.buckets = state["hash_buckets"]

    # ---- reading -------------------------------------------------------------------------------------------------------

    def state(self) -> dict:
        """The newest manifest; what it names stays for RETAIN seconds after the next one."""
        return self.manifests.load()

    def rows_path(self, segment: str) -> str:
        return f"{self.path}/rows/{segment}"

    def index_path(self, name: str) -> str:
        return f"{self.path}/index/{name}"

    def _paths(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, state: dict | None = None) -> DataFrame:
        return self._paths([self.rows_path(s["name"]) for s in (state or self.state())["segments"]])

    def keyed(self, segment: str, place: int = 0) -> DataFrame:
        """The rows of a segment with _key, their address."""
        return self._paths([self.rows_path(segment)]).select("*", row_key(place).alias("_key"))

    def fetch(self, keys: list[int], state: dict) -> DataFrame:
        """The rows with these keys, with _key, from the files that hold them and no others."""
        wanted: dict[int, dict[int, list[int]]] = {}
        for key in keys:
            place, local = divmod(key, PLACE)
            wanted.setdefault(place, {}).setdefault(local // _ROW, []).append(key)
        out = None
        for place, files in wanted.items():
            found = {}
            for s in self.manifests.listed(self.rows_path(state["segments"][place]["name"])):
                name = s.getPath().getName()
                if name.startswith("part-"):
                    found[int(name.split("-")[1]) * (_TASK // _ROW) + int(name.split("-c")[-1].split(".")[0])] = s.getPath().toString()
            rows = self._paths([found[f] for f in files]).select("*", row_key(place).alias("_key")).where(F.col("_key").isin([k for ks in files.values() for k in ks]))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.schema).withColumn("_key", F.lit(0).cast("long"))

    def files(self) -> int:
        return sum(x.getPath().getName().endswith(".parquet") for s in self.state()["segments"] for x in self.manifests.listed(self.rows_path(s["name"])))

    # ---- writing -------------------------------------------------------------------------------------------------------

    def shape(self, rows: DataFrame, workflow: str) -> DataFrame:
        """Rows in the vault's columns; a vector of another width stops the job."""
        rows = rows.withColumn("workflow", F.lit(workflow))
        checked = F.when(F.size("vector") == self.dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors must have {self.dim} components")).cast("array<float>"))
        rows = rows.withColumn("vector", checked)
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in self.schema]
        return rows.select(cols)

    def _stage(self, rows: DataFrame) -> dict:
        """Write a segment that no manifest names yet."""
        name = f"s-{uuid.uuid4().hex}"
        rows.write.parquet(self.rows_path(name))
        written = self._paths([self.rows_path(name)])
        n = written.count()
        if n:
            table = f"brindle_{uuid.uuid4().hex}"
            once = written.select("content_hash").distinct().repartition(self.buckets, "content_hash")  # copies are dropped before they are dealt
            once.write.bucketBy(self.buckets, "content_hash").sortBy("content_hash").option("path", f"{self.path}/hashes/segment={name}").format("parquet").saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # the files stay, as the table had a path of its own
        return {"name": name, "rows": n, "vectors": None, "words": None}

    def append(self, rows: DataFrame, workflow: str = "default", *, ingest: str | None = None) -> int:
        """Add rows as one segment: how many. Under an ingest key that the manifest has, nothing is added."""
        if ingest is not None and ingest in self.state()["ingests"]:
            return 0
        segment = self._stage(self.shape(rows, workflow))

        def added(s: dict) -> dict | None:
            if ingest is not None and ingest in s["ingests"]:
                return None
            s["segments"] += [segment] if segment["rows"] else []
            s["ingests"] += [ingest] if ingest is not None else []
            return s

        after = self.manifests.commit(added)
        held = segment["name"] in (s["name"] for s in after["segments"])
        if not held:
            self._remove(segment)
        return segment["rows"] if held else 0

    def clear(self) -> None:
        old = self.state()
        self.manifests.commit(lambda s: s | {"segments": [], "ingests": []})
        self._sweep(old)

    def indexed(self, segment: str, **names: str) -> None:
        """Name indexes of a segment, unless it has gone meanwhile."""

        def change(s: dict) -> dict | None:
            held = [x for x in s["segments"] if x["name"] == segment]
            for x in held:
                x.update(names)
            return s if held else None

        self.manifests.commit(change)

    def compact(self, rows_per_file: int = 250_000, *, slack: int = 64) -> None:
        """Merge small segments where there are more than MOST_SEGMENTS, or all where they have more than ``slack`` files too many."""
        state = self.state()
        held = sorted(state["segments"], key=lambda s: s["rows"])
        total = sum(s["rows"] for s in held)
        if self.files() > slack + total // rows_per_file:
            some = held
        elif len(held) > MOST_SEGMENTS:
            # the smallest, and further ones while they are no larger than twice what is merged so far
            upto, n = 2, held[0]["rows"] + held[1]["rows"]
            while upto < len(held) and (held[upto]["rows"] <= 2 * n or len(held) - upto >= MOST_SEGMENTS):
                n += held[upto]["rows"]
                upto += 1
            some = held[:upto]
        else:
            return
        names = {s["name"] for s in some}
        rows = self._paths([self.rows_path(s["name"]) for s in state["segments"] if s["name"] in names])
        merged = self._stage(rows.repartition(max(1, -(-sum(s["rows"] for s in some) // rows_per_file)), "id"))

        def replaced(s: dict) -> dict | None:
            if not names <= {x["name"] for x in s["segments"]}:
                return None
            at = [x["name"] in names for x in s["segments"]].index(True)
            s["segments"][at:at] = [merged]
            s["segments"] = [x for x in s["segments"] if x["name"] not in names]
            return s

        after = self.manifests.commit(replaced)
        if merged["name"] not in (s["name"] for s in after["segments"]):
            self._remove(merged)
        self._sweep(after)

    def _remove(self, segment: dict) -> None:
        for p in (self.rows_path(segment["name"]), f"{self.path}/hashes/segment={segment['name']}"):
            remove(self.spark, p)

    def _sweep(self, state: dict) -> None:
        """Delete what no manifest names and RETAIN seconds have passed over: readers and writers that began before can end."""
        now = self.state()
        keep = {x for st in (state, now) for s in st["segments"] for x in (s["name"], s["vectors"], s["words"]) if x}
        for folder in ("rows", "hashes", "index"):
            for s in self.manifests.listed(f"{self.path}/{folder}"):
                name = s.getPath().getName()
                if name.removeprefix("segment=") not in keep and time.time() - s.getModificationTime() / 1000 > RETAIN:
                    remove(self.spark, f"{self.path}/{folder}/{name}")
        for s in self.manifests.listed(self.manifests.path)[:-2]:
            if time.time() - s.getModificationTime() / 1000 > RETAIN and s.getPath().getName() < f"v-{now['version'] - 1:012d}":
                remove(self.spark, s.getPath().toString())

    # ---- content hashes ------------------------------------------------------------------------------------------------

    def hashes(self) -> DataFrame:
        return self.stored_hashes().distinct()

    def stored_hashes(self) -> DataFrame:
        """(content_hash) of each segment, from files in buckets of the hash: a join on it needs no exchange of them."""
        names = [s["name"] for s in self.state()["segments"]]
        if not names:
            return self.spark.createDataFrame([], "content_hash string")
        table = f"brindle_hashes_{uuid.uuid5(uuid.NAMESPACE_URL, self.path + str(sorted(names))).hex}"
        if not self.spark.catalog.tableExists(table):
            spec = f"PARTITIONED BY (segment) CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {table} (content_hash STRING, segment STRING) USING parquet {spec} LOCATION '{self.path}/hashes'")
            # only what the manifest names counts
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (segment='{n}')" for n in names))
        return self.spark.table(table).select("content_hash")

    def unseen(self, chunks: DataFrame) -> DataFrame:
        return unseen(chunks, self.stored_hashes())


def unseen(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """Chunks whose content_hash the snapshot of hashes does not hold."""
    return chunks.join(hashes.select("content_hash"), "content_hash", "left_anti")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def results(rows: DataFrame) -> DataFrame:
    """Search rows with score (equal to distance), distance and is_fts_match (no distance)."""
    return rows.withColumn("score", F.col("distance")).withColumn("is_fts_match", F.col("distance").isNull())
