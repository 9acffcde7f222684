"""k-means over integer vectors by sort-means (Phillips, 2002), exact in every step.

Each round orders the other centroids by their distance from each centroid. A vector begins at the centroid it was
assigned to before and goes through the others in that order; it stops strictly beyond twice its distance to the one it
began at, as no centroid farther out can be as near, ties included. Vectors lie packed in blocks of some thousand; a
round reads the blocks of the last, and writes them with their new assignments and each task's sums of each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.session import discard, materialize, ship_package

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
BLOCK = 8192
#: Components at or above this have no squared distance in 64 bits; vectors with one are left out.
LIMIT = 1 << 27
#: Below this, distances in double precision are exact.
EXACT = 1 << 22
_BLOCKS = "kind int, ids array<long>, width int, data binary, at binary, cluster int, part int, total long"
_NAMES = [x.split(" ")[0] for x in _BLOCKS.split(", ")]
_TYPES = [pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to c (a row, or one for each), in whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


class Centroids:
    """Centroids with, for each, the others in order of their squared distance from it."""

    def __init__(self, c: np.ndarray):
        self.c = c
        gap = np.stack([squares(c, row) for row in c]) if len(c) else np.zeros((0, 0), np.int64)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, 1)

    def assign(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, squared distance to it, distances told) for rows of x, from the centroids at that they had."""
        exact = max(np.abs(x).max(initial=0), np.abs(self.c).max(initial=0)) < EXACT
        x, c = (x.astype(np.float64), self.c.astype(np.float64)) if exact else (x, self.c)
        own = squares(x, c[at])
        best, least, told = at.astype(np.int64), own.copy(), len(x)
        for a in np.unique(at):
            rows = np.flatnonzero(at == a)
            for j, gap in zip(self.order[a].tolist(), self.gap[a].tolist()):
                if j == a:
                    continue
                # gap > 4 * own, without leaving 64 bits
                rows = rows[own[rows] > (gap - 1) // 4]
                if not len(rows):
                    break
                d = squares(x[rows], c[j])
                told += len(rows)
                better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
                best[rows[better]], least[rows[better]] = j, d[better]
        return best, least, told


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64)


def _pack(x: np.ndarray) -> tuple[int, bytes]:
    width = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4
    return width, x.astype(f"<i{width}").tobytes()


def _unpack(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, WIDTH).astype(np.int64)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that count."""
    inside = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(LIMIT // SCALE))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == WIDTH) & F.coalesce(inside, F.lit(False)))


def _blocks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                x = whole_numbers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
                yield _row(0, part.column(0).to_pylist(), *_pack(x), bytes(len(x)), None, None, None)

    return rows.mapInArrow(run, _BLOCKS)


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for ids, width, data, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
        yield ids, width, data, _unpack(width, data), np.frombuffer(at, np.uint8).astype(np.int64)


def _round(blocks: DataFrame, centroids: Centroids) -> DataFrame:
    """The blocks with new assignments (kind 0), and each task's count (part WIDTH) and sums of each cluster (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.c)
        total = np.zeros((k, WIDTH + 1), np.int64)
        for batch in batches:
            for ids, width, data, x, at in _read(batch):
                best, _, _ = centroids.assign(x, at)
                total[:, WIDTH] += np.bincount(best, minlength=k)
                np.add.at(total[:, :WIDTH], best, x)
                yield _row(0, ids, width, data, best.astype(np.uint8).tobytes(), None, None, None)
        cluster, part = np.nonzero(total)
        n = len(cluster)
        cols = ([1] * n, [None] * n, [None] * n, [None] * n, [None] * n, cluster, part, total[cluster, part])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return blocks.where("kind = 0").select("ids", "width", "data", "at").mapInArrow(run, _BLOCKS)


def _moved(sums: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floors of the means of all clusters that are not empty; others stay. A row for each cluster and component."""
    added = sums.where("kind = 1").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {(r.cluster, r.part): int(r.total) for r in added.collect()}
    return np.array([[total.get((k, j), 0) // n for j in range(WIDTH)] if (n := total.get((k, WIDTH), 0)) else row for k, row in enumerate(c.tolist())], np.int64).reshape(-1, WIDTH)


def cluster(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors (vec_id, embedding, ...).

    Counted are vectors of exactly WIDTH components that are neither null nor non-finite and whose floors of SCALE times
    are below LIMIT, as others have no squared distance in 64 bits; the rest have no row. The first centroids are those
    whose ids' hashes are smallest, ties by the vector's components, a null vec_id (which stays null) last; with fewer
    vectors than ``clusters`` (255 at most) there are as many centroids as vectors. Rows that repeat a vec_id count each.
    No vectors give no rows. Other columns are ignored."""
    if not 0 < clusters < 256:
        raise ValueError("1 to 255 clusters")
    spark = vectors.sparkSession
    ship_package(spark)
    rows = kept(vectors)
    first = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("_h"), "embedding").limit(clusters)
    c = whole_numbers(np.array([r.embedding for r in first.select("embedding").collect()], np.float64).reshape(-1, WIDTH))
    now = materialize(_blocks(rows), "sort-means")
    for _ in range(rounds if len(c) else 0):
        after = materialize(_round(now, Centroids(c)), "sort-means", partition_by=["kind"])
        discard(now)
        now, c = after, _moved(after, c)
    last = Centroids(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, x, at in _read(batch):
                best, least, _ = last.assign(x, at)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = materialize(now.where("kind = 0").select("ids", "width", "data", "at").mapInArrow(run, "vec_id long, cluster int, distance long"), "sort-means-last")
    discard(now)
    # a row for each cluster
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = [(k, sums.get(k, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(c.tolist())]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in DuckDB: every vector against every centroid in each round."""
    square = "list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.c[j]) * (v.x[j] - c.c[j])))::BIGINT"
    floors = "((s - ((s % n) + n) % n) // n)::BIGINT"
    out = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, x AS c FROM v QUALIFY k < {clusters})",
    ]
    for r in range(rounds + 1):
        out.append(f"d{r} AS MATERIALIZED (SELECT vec_id, x, k, {square} AS d FROM v, c{r} AS c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT k, j, sum(x[j]) AS s, count(*) AS n FROM d{r}, (SELECT unnest(range(1, 65)) AS j) GROUP BY k, j)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} AS c LEFT JOIN (SELECT k, list({floors} ORDER BY j) AS c FROM s{r} GROUP BY k) m USING (k))")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM d{rounds} JOIN c{rounds} AS c USING (k)"""
