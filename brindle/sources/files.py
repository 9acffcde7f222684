"""Files to documents (filepath, content, content_hash)."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.scalars import content_hash, normalized_lines

#: Extensions that each kind of chunker takes from a directory.
EXTENSIONS = {"document": (".md", ".txt"), "sql": (".json",), "duckdb": (".duckdb",), "api": ()}


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def find(path: str, extensions: tuple[str, ...]) -> list[str]:
    """Regular files below a directory with one of the extensions, or all that a glob pattern or path matches."""
    if os.path.isdir(path):
        return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(extensions) and os.path.isfile(os.path.join(d, n)))
    return sorted(p for p in glob.glob(path, recursive=True) if os.path.isfile(p))


def _escaped(path: str) -> str:
    """A path that Spark's listing takes as it stands: the characters of its patterns are escaped."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """Text files as documents. Files that aren't UTF-8 are skipped; line ends become line feeds before hashing.

    A file without content is hashed by its path and time of change. A directory is listed by Spark at once, whatever the
    number of its files, and so is a URI with a scheme, where names that begin with _ or a full stop and empty files
    are left out; of a local directory these are added. File names may hold any character, those of patterns too."""
    empty = spark.createDataFrame([], "filepath string, content string, content_hash string")
    reader = spark.read.format("binaryFile")
    if "://" in path:
        raw = _by_extension(spark, path, extensions)
    else:
        found = find(path, extensions)
        if not found:
            return empty
        visible = [p for p in found if os.path.getsize(p) and not any(x.startswith(("_", ".")) for x in os.path.relpath(p, path if os.path.isdir(path) else os.path.dirname(p)).split(os.sep))]
        hidden = sorted(set(found) - set(visible))
        raw = None
        if visible:
            raw = _by_extension(spark, _escaped(os.path.abspath(path)), extensions) if os.path.isdir(path) else reader.load([_escaped(os.path.abspath(p)) for p in visible])
        if hidden:
            # Spark's listing leaves these out, as it does empty files: tasks read them by name, so executors must see the path
            rows = [(os.path.abspath(p), os.path.getmtime(p)) for p in hidden]
            own = spark.createDataFrame(rows, "path string, t double").repartition(len(rows) // 64 + 1).mapInPandas(_contents, "path string, t double, content binary")
            own = own.select("path", F.timestamp_seconds("t").alias("modificationTime"), F.length("content").cast("long").alias("length"), "content")
            raw = own if raw is None else raw.unionByName(own)
    name = F.regexp_replace("path", "^file:/*", "/")
    text = normalized_lines(F.try_validate_utf8("content"))
    docs = raw.select(name.alias("filepath"), text.alias("content"), F.col("modificationTime").cast("string").alias("t")).where("content is not null")
    return docs.select("filepath", "content", F.when(F.col("content") == "", content_hash(F.concat("filepath", "t"))).otherwise(content_hash(F.col("content"))).alias("content_hash"))


def _by_extension(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    glob_ = "*{" + ",".join(extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_).load(path)


def _contents(frames):
    for pdf in frames:
        pdf["content"] = [open(p, "rb").read() for p in pdf["path"]]
        yield pdf
