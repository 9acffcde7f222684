"""A vault with indexes over its segments: rows are found from the moment that their segment is in the manifest.

Segments without an index, be it that they are small, that it is still to be built or that its build failed, are
searched exactly; an index is built over one segment, written whole, and then named in the manifest. A search reads one
manifest, ranks by the indexes, and fetches its k rows from the files that hold them.
"""

from __future__ import annotations

import logging
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from brindle.operators import fts, ivfpq, store
from brindle.operators.search import CANDIDATES, knn, prefilter, search as retrieve

log = logging.getLogger("brindle.collection")


class Collection:
    def __init__(self, vault: store.Vault, nprobes: int = ivfpq.NPROBES, *, exact: bool = False):
        """exact: searches also read the parts of an index that can hold nearer rows than those found, so that they miss none."""
        self.vault, self.spark, self.nprobes, self.exact = vault, vault.spark, nprobes, exact
        self.filters = tuple(c for c in ("source", "execution_time_ms") if c in vault.schema.names)

    def add(self, rows: DataFrame, workflow: str = "default", *, ingest: str | None = None) -> int:
        """Append rows, merge small segments and index what has no index: rows added. An ingest key counts once."""
        added = self.vault.append(rows, workflow, ingest=ingest)
        if added:
            self.vault.compact()
        self.index()
        return added

    def index(self) -> None:
        """Build the indexes that segments lack. A failed build is logged, and its segment is searched exactly until the next one."""
        for segment in self.vault.state()["segments"]:
            rows = self.vault.keyed(segment["name"])
            if segment["vectors"] is None and ivfpq.sizing(segment["rows"], self.vault.dim):
                self._build(segment["name"], "vectors", lambda path, rows=rows: ivfpq.build(rows, path, id_="_key", keep=self.filters))
            if segment["words"] is None:
                self._build(segment["name"], "words", lambda path, rows=rows: fts.build_blocks(rows, path, keep=self.filters))

    def _build(self, segment: str, kind: str, make) -> None:
        name = f"{kind}-{uuid.uuid4().hex}"
        try:
            made = make(self.vault.index_path(name))
        except (PySparkException, Py4JJavaError) as e:
            log.warning("no index of %s over %s: %s", kind, segment, str(e).splitlines()[0])
            return
        if made:
            facts = {"texts": made[0], "terms": made[1]} if kind == "words" else {}
            self.vault.indexed(segment, **{kind: name}, **facts)

    def nearest(self, state: dict, vector: list[float], most: int, source: str | None = None, min_time: float | None = None) -> DataFrame:
        """(id, distance): from each index its best rows, and exact ones of the other segments."""
        found, loose = [], []
        for place, s in enumerate(state["segments"]):
            if s["vectors"]:
                one = ivfpq.search(self.spark, self.vault.index_path(s["vectors"]), vector, most, nprobes=self.nprobes, source=source, min_time=min_time, exact=self.exact)
                found.append(one.select((F.col("id") + F.lit(place * store.PLACE)).alias("id"), "distance"))
            else:
                loose.append(self.vault.keyed(s["name"], place))
        if loose:
            exact = prefilter(store.union(loose), source, min_time).select(F.col("_key").alias("id"), "vector")
            found.append(knn(exact, vector, most).select("id", "distance"))
        return store.union(found).where("distance is not null").orderBy("distance", "id").limit(most)

    def lexical(self, state: dict, query: str, most: int, source: str | None = None, min_time: float | None = None) -> DataFrame | None:
        """(id, relevance) of the best texts; None where an index that the manifest names can't be opened."""
        parts, loose, n, total = [], [], 0, 0
        for place, s in enumerate(state["segments"]):
            if s["words"]:
                opened = fts.open_blocks(self.spark, self.vault.index_path(s["words"]))
                if opened is None:
                    return None
                parts.append((place * store.PLACE, *opened, s["terms"] / s["texts"] if s["texts"] else 0.0))
                n, total = n + s["texts"], total + s["terms"]
            else:
                loose.append(self.vault.keyed(s["name"], place).withColumnRenamed("id", "_id").withColumnRenamed("_key", "id"))
        rest = store.union(loose) if loose else None
        if rest is not None:
            own = fts.statistics(rest).first()
            n, total = n + own.n, total + (own.avg_length or 0) * own.n
        only = (lambda rows: prefilter(rows, source, min_time)) if source or min_time is not None else None
        found, _, _ = fts.search_blocks(parts, rest, n, total / n if n else 0.0, query, most, only=only)
        return found if found is not None else self.spark.createDataFrame([], "id long, relevance double")

    def ranked(self, state: dict, query: str, vector: list[float], k: int, source: str | None = None, min_time: float | None = None) -> DataFrame:
        """(id, distance, relevance, fused) of the k best rows, ids being addresses."""
        near, words = self.nearest(state, vector, CANDIDATES, source, min_time), self.lexical(state, query, CANDIDATES, source, min_time)
        return retrieve(near, query, vector, k, lexical=words, nearest=near, texts=words is not None)

    def search(self, query: str, vector: list[float], k: int = 5, *, source: str | None = None, min_time: float | None = None) -> list[dict]:
        """At most k rows as dictionaries: the vault's columns but the vector, with score, distance and is_fts_match; filters hold before ranking."""
        state = self.vault.state()
        if not state["segments"]:
            return []
        best = {r.id: r for r in self.ranked(state, query, vector, k, source, min_time).collect()}  # k rows
        rows = {r._key: r.asDict(recursive=True) for r in self.vault.fetch(list(best), state).drop("vector").collect()}
        order = sorted(best.values(), key=lambda r: (-(r.fused or 0), r.distance is None, r.distance or 0, r.id))
        return [{c: v for c, v in rows[r.id].items() if c != "_key"} | {"distance": r.distance, "score": r.distance, "is_fts_match": r.distance is None} for r in order]
