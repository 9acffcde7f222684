"""The two lifecycles: ingest (read, chunk, drop what is known, embed, append, index what is new) and search."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.embedding import Embedder, embed_passages, embed_query, hashing_embedder, token_embedder
from brindle.operators import chunking, records, store
from brindle.plans.collection import Collection
from brindle.plans.config import Engine, Settings
from brindle.sources import files
from brindle.sources.duckfile import read_duckfile
from brindle.sources.http_api import read_http

log = logging.getLogger("brindle.engine")


class RetrievalEngine:
    def __init__(self, spark: SparkSession, spec: Engine, settings: Settings | None = None, make_embedder: Callable[[], Embedder] | None = None):
        self.spark, self.spec, self.settings = spark, spec, settings or Settings()
        dim, tokens = spec.vector_dimension, spec.max_token_length  # tokens: the window of embedders that have one
        file = self.settings.tokenizer_file
        self.make = make_embedder or ((lambda: token_embedder(file, dim, tokens)) if file else (lambda: hashing_embedder(dim)))
        self.key = (spec.model_name, dim, tokens, file)
        self.root = f"{self.settings.db_path.rstrip('/')}/{spec.table_name}"
        self.vault = store.Vault(spark, f"{self.root}/vault", spec.mapper_type, dim)
        self.collection = Collection(self.vault, self.settings.nprobes)

    def chunks(self, path: str, query: str | None = None, run_ts: datetime | None = None) -> DataFrame:
        """Chunks of a directory, glob, file or URL, by the engine's chunker."""
        kind = self.spec.chunker_type
        now = F.lit((run_ts or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
        options = self.spec.source_options()
        if kind == "api":
            url = path if files.is_url(path) else options.pop("base_url", "")
            # a key in the environment goes before one in the file
            given = {"api_key": os.environ.get("BRINDLE_API_KEY"), "query": query}
            merged = {k: v for k, v in options.items() if k != "base_url"} | {k: v for k, v in given.items() if v}
            return records.project_sql_chunks(records.with_required(read_http(self.spark, url, **merged)), now)
        if kind == "duckdb":
            rows = read_duckfile(self.spark, files.find(path, files.EXTENSIONS["duckdb"]), query or options.get("query"), per_file=True, skip_broken=True)
            if rows is None:
                rows = self.spark.createDataFrame([], "id string, text string, source string")
            elif missing := {"id", "text", "raw_query", "source", "execution_time_ms", "calls"} - set(rows.columns):
                log.warning("%s: the query gives no %s", path, ", ".join(sorted(missing)))
                if {"id", "text", "source"} & missing:
                    raise ValueError(f"{path}: the query must give id, text and source")
            return records.project_sql_chunks(records.with_required(rows), now)
        docs = files.read_documents(self.spark, path, files.EXTENSIONS[kind])
        if kind == "sql":
            return records.from_log_records(records.parse_json_arrays(docs).drop("filepath"), now)
        return chunking.chunk_documents(docs, options.get("max_chars", chunking.MAX_CHARS))

    def ingest(self, path: str, *, rebuild: bool = False, query: str | None = None, distinct: bool = False, ingest_id: str | None = None) -> int:
        """Rows added. What the vault holds is told by content hash from a snapshot at the start; repeats within a run stay unless distinct.

        Rows of an ingest come in together or not at all; one that is repeated under its ingest_id adds nothing."""
        if rebuild:
            self.vault.clear()
        return self.add(self.chunks(path, query), distinct=distinct, ingest_id=ingest_id)

    def add(self, chunks: DataFrame, *, distinct: bool = False, ingest_id: str | None = None) -> int:
        """Rows added of chunks, such as a micro-batch under its number as ingest_id."""
        if distinct:
            chunks = chunks.dropDuplicates(["content_hash", "id"])
        # the anti-join stands below the embedder: only new chunks are embedded
        ready = embed_passages(self.vault.unseen(chunks), self.make, self.key, self.spec.vector_dimension, prefix=self.spec.passage_prefix, batch=self.settings.batch_size)
        return self.collection.add(ready, self.spec.workflow, ingest=ingest_id)

    def search(self, query: str, k: int = 5, *, source: str | None = None, min_time: float | None = None) -> list[dict]:
        """At most k rows as dictionaries: the vault's columns but the vector, with score, distance and is_fts_match."""
        vector = embed_query(self.make(), query, self.spec.vector_dimension, self.spec.query_prefix)
        return self.collection.search(query, vector, k, source=source, min_time=min_time if self.spec.mapper_type == "sql" else None)
