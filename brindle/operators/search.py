"""Top-k retrieval: exact vectors, full text, and both fused by reciprocal ranks, filters applied before ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from brindle.functions.scalars import cosine_distance
from brindle.operators.fts import bm25
from brindle.session import materialize, ship_package

RRF_K, CANDIDATES = 60, 50


def prefilter(rows: DataFrame, source: str | None = None, min_time: float | None = None, time_column: str = "execution_time_ms") -> DataFrame:
    """source: exact, none or empty means all. min_time: inclusive, 0 counts."""
    if source:
        rows = rows.where(F.col("source") == F.lit(source))
    if min_time is not None:
        rows = rows.where(F.col(time_column) >= F.lit(min_time))
    return rows


def knn(rows: DataFrame, vector: list[float], k: int = 5, *, column: str = "vector", id_: str = "id") -> DataFrame:
    """The k rows nearest by cosine, ties by id; rows with a zero vector come last, without a distance."""
    with_distance = rows.withColumn("distance", cosine_distance(F.col(column), vector))
    return with_distance.orderBy(F.asc_nulls_last("distance"), id_).limit(k)


#: Queries that are laid against all rows in one pass, and rows that they meet at a time.
QUERY_BLOCK, STRIP = 2048, 1024


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors scaled to length 1) of queries (query_id, query_vector), ``size`` at a time; zero vectors stay zero."""
    rows = queries.where("query_vector is not null").select("query_id", "query_vector").toLocalIterator(prefetchPartitions=False)
    while held := list(islice(rows, size)):
        q = np.array([r["query_vector"] for r in held], np.float64)
        yield np.array([r["query_id"] for r in held]), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)


def knn_many(rows: DataFrame, queries: DataFrame, k: int = 5, *, column: str = "vector", id_: str = "id", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, distance, rank) for queries (query_id, query_vector) against all rows, ties by id.

    Queries pass the driver in blocks; each block is one pass over the rows, in which each partition keeps its k best of
    each query before anything is shuffled. Rows and queries with a null or zero vector have no neighbours."""
    ship_package(rows.sparkSession)
    ids = rows.where(F.col(column).isNotNull()).select(F.col(id_).cast("long").alias("i"), F.col(column).alias("v"))
    found = [_knn_block(ids, qid, q, k) for qid, q in query_blocks(queries, block)]
    if not found:
        return rows.select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where(F.lit(False))
    if len(found) > 1:
        # a plan of bounded size, however many the blocks
        found = [materialize(x, "knn-block") for x in found]
    return reduce(DataFrame.unionByName, found)


def _knn_block(ids: DataFrame, qid: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    import pandas as pd

    held = ids.sparkSession.sparkContext.broadcast((qid, q))  # at most QUERY_BLOCK vectors

    def run(frames):
        qid, q = held.value
        asked = (q != 0).any(axis=1)

        def nearest(d, i):
            """The k least of each row, ties by id; all that equal the k-th are looked at."""
            if d.shape[1] > k:
                last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                most = int((d <= last).sum(axis=1).max())
                few = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.broadcast_to(np.arange(most), (len(d), most))
                d, i = np.take_along_axis(d, few, 1), np.take_along_axis(i, few, 1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

        best_d, best_i = np.full((len(qid), 0), np.inf), np.zeros((len(qid), 0), np.int64)
        for pdf in frames:
            if not len(pdf):
                continue
            every, ids = np.stack(pdf["v"].to_numpy()), pdf["i"].to_numpy(np.int64)
            for a in range(0, len(ids), STRIP):
                x = every[a : a + STRIP].astype(np.float64)
                norms = np.linalg.norm(x, axis=1)
                d = np.where((norms > 0) & asked[:, None], 1 - (q @ x.T) / np.where(norms > 0, norms, 1), np.inf)
                best_d, best_i = nearest(np.concatenate((best_d, d), axis=1), np.concatenate((best_i, np.broadcast_to(ids[a : a + STRIP], d.shape)), axis=1))
        n = best_d.shape[1]
        out = pd.DataFrame({"query_id": np.repeat(qid, n), "id": best_i.ravel(), "distance": best_d.ravel()})
        yield out[np.isfinite(out["distance"])]

    near = ids.mapInPandas(run, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(near: DataFrame, words: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Candidates (id, distance) and (id, relevance), each list bounded, fused by reciprocal ranks: (id, distance, relevance, fused)."""
    near = near.withColumn("rank_v", F.row_number().over(Window.orderBy("distance", "id")))
    words = words.withColumn("rank_t", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = near.join(words, "id", "full_outer").withColumn("fused", F.round(part("rank_v") + part("rank_t"), 9))
    return fused.select("id", "distance", "relevance", "fused").orderBy(F.desc("fused"), "id").limit(k)


def hybrid(
    rows: DataFrame, query: str, vector: list[float], k: int = 5, *, id_: str = "id", column: str = "vector", text: str = "text",
    candidates: int = CANDIDATES, rrf_k: int = RRF_K, lexical: DataFrame | None = None, nearest: DataFrame | None = None,
) -> DataFrame:
    """The k best (id, distance, relevance, fused) of the vector and the text candidates; distance is null for a hit by text alone.

    lexical: (id, relevance) and nearest: (id, distance) from stored indexes, else BM25 and exact cosines over rows. Each
    list has ``candidates`` rows at most, so ranks and fusion are small."""
    if nearest is None:
        nearest = knn(rows.select(F.col(id_).alias("id"), F.col(column).alias("v")), vector, candidates, column="v")
    near = nearest.where("distance is not null").select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id").limit(candidates)
    words = bm25(rows, query, id_=id_, text=text) if lexical is None else lexical
    words = words.select("id", F.round("relevance", 6).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(candidates)
    return fuse(near, words, k, rrf_k)


def search(rows: DataFrame, query: str, vector: list[float], k: int = 5, *, lexical: DataFrame | None = None, nearest: DataFrame | None = None, texts: bool = True, **how) -> DataFrame:
    """hybrid(), or vectors alone without ``texts``, for when the text index can't be opened. Errors of either are raised."""
    if texts:
        return hybrid(rows, query, vector, k, lexical=lexical, nearest=nearest, **how)
    id_, column = how.get("id_", "id"), how.get("column", "vector")
    near = knn(rows, vector, k, column=column, id_=id_).select(F.col(id_).alias("id"), "distance") if nearest is None else nearest.orderBy("distance", "id").limit(k)
    return near.select("id", F.round("distance", 6).alias("distance"), F.lit(None).cast("double").alias("relevance"), F.lit(None).cast("double").alias("fused"))
