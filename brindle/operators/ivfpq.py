"""Inverted-file, product-quantised vector index (Jégou et al., 2011) in two levels, stored as Parquet.

Every cell is parted again into small parts. A search tells for each query, from the parts' means, spreads and sizes, how
many of its nearest rows each part is likely to hold, and reads the best parts until they should hold the wanted share;
easy queries so read little. The codes of those parts give each query the similarity that its k-th row has by them, and
all rows that come as near to it as codes err get exact distances from their vectors, however many these are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.session import materialize, ship_package

THRESHOLD = 256
#: Rows that the centroids and codebooks are fitted on, at most (about).
SAMPLE = 50_000
#: Parts of a cell at most, and the sampled rows of a part at least.
PARTS, LEAST = 16, 2
#: Cells whose number of rows a query reads at most in an index of CELLS cells; one of more cells is read to the same share.
NPROBES, CELLS = 20, 60
#: The share of its k nearest rows that the parts which a query reads shall hold, and within how many deviations of the codes' error rows get exact distances.
TARGET, MARGIN = 0.93, 3.0
#: Queries whose parts are chosen at a time, and exact distances that a task holds before it keeps the k nearest of each query.
CHOSEN, PAIRS = 32, 1 << 20


def sizing(n: int, dim: int) -> tuple[int, int] | None:
    """(cells, sub-vectors) for n rows, or None where an index isn't worth building."""
    if n <= THRESHOLD:
        return None
    return max(1, min(256, math.isqrt(n))), max(1, min(16, dim // 8))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above z (Abramowitz & Stegun 26.2.17)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = np.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


class Cells:
    """Unit centroids of cells and of their parts (part p lies in cell owner[p]); vectors go to the nearest part of the nearest cell."""

    def __init__(self, cells: np.ndarray, parts: np.ndarray, owner: np.ndarray):
        self.cells, self.parts, self.owner = cells, parts, owner
        self.first = np.searchsorted(owner, np.arange(len(cells) + 1))

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> "Cells":
        c = _unit(_kmeans(x, cells))
        at, parts, owner = np.argmax(x @ c.T, axis=1), [], []
        for j in range(len(c)):
            own = x[at == j]
            some = _unit(_kmeans(own, max(1, min(PARTS, len(own) // LEAST)), 8, j)) if len(own) else c[j : j + 1]
            parts.append(some), owner.append(np.full(len(some), j))
        return cls(c, np.concatenate(parts), np.concatenate(owner))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each vector."""
        at = np.argmax(x @ self.cells.T, axis=1)
        out = np.zeros(len(x), np.int64)
        for j in np.unique(at):
            rows, a, b = np.flatnonzero(at == j), self.first[j], self.first[j + 1]
            out[rows] = a + np.argmax(x[rows] @ self.parts[a:b].T, axis=1)
        return out


def build(rows: DataFrame, path: str, *, id_: str = "id", column: str = "vector", keep: tuple[str, ...] = (), sample: int = SAMPLE, codes: int = 256) -> bool:
    """Index every row with a vector at path, which must be new, with the columns to keep for filters. False if there are too few rows.

    Centroids, means and codebooks come from a sample of bounded size; the parts' sizes are counted over all rows."""
    spark = rows.sparkSession
    ship_package(spark)
    rows = rows.where(F.col(column).isNotNull())
    first = rows.select(F.size(column)).limit(1).collect()
    n = rows.count()
    size = sizing(n, first[0][0]) if first else None
    if size is None:
        return False
    cells, subs = size
    scale = 1 << 30
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), id_), F.lit(scale)) < int(scale * min(1.0, sample / n))).select(id_, column).toPandas().sort_values(id_)
    x = _unit(np.stack(drawn[column].to_numpy()).astype(np.float32))
    parted = Cells.fit(x, cells)
    part = parted.place(x)
    means = np.stack([x[part == p].mean(axis=0) if (part == p).any() else parted.parts[p] for p in range(len(parted.parts))])
    edges = np.linspace(0, x.shape[1], subs + 1).astype(int)
    residual = x - parted.parts[part]
    books = [_kmeans(residual[:, a:b], codes) for a, b in zip(edges[:-1], edges[1:])]
    off = sum(float(np.min((bk * bk).sum(1)[None] - 2 * r @ bk.T + (r * r).sum(1)[:, None], axis=1).clip(0).sum()) for bk, r in ((bk, residual[:, a:b]) for bk, a, b in zip(books, edges[:-1], edges[1:])))
    error = math.sqrt(off / x.size)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            v = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float32))
            at = parted.place(v)
            r = v - parted.parts[at]
            code = np.stack([np.argmin((bk * bk).sum(1)[None] - 2 * r[:, a:b] @ bk.T, axis=1) for bk, a, b in zip(books, edges[:-1], edges[1:])], axis=1)
            near = np.einsum("ij,ij->i", v, parted.parts[at]).astype(np.float64)
            named = {"id": pdf["i"], "vector": pdf["v"], "pq_code": list(code.astype(np.int16)), "part": at.astype(np.int32), "near": near, "ivf_cell": parted.owner[at].astype(np.int32)}
            yield pd.DataFrame(named | {c: pdf[c] for c in keep})

    coded = rows.select(F.col(id_).alias("i"), F.col(column).cast("array<float>").alias("v"), *keep)
    types = {c: rows.schema[c].dataType.simpleString() for c in (id_, *keep)}
    schema = f"id {types[id_]}, vector array<float>, pq_code array<smallint>, part int, near double, ivf_cell int" + "".join(f", `{c}` {types[c]}" for c in keep)
    # a cell is dealt over tasks by its parts, and sorted by them, so that files and row groups hold few parts
    placed = coded.mapInPandas(encode, schema).repartition("ivf_cell", F.pmod(F.xxhash64("part"), F.lit(8))).sortWithinPartitions("ivf_cell", "part", "id")
    placed.write.partitionBy("ivf_cell").parquet(f"{path}/rows")
    # at most 256 * PARTS rows
    counted = {r.part: (r.n, r.near) for r in spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()}
    meta = [("cells", k, c.tolist()) for k, c in enumerate(parted.cells)]
    meta += [("parts", k, c.tolist()) for k, c in enumerate(parted.parts)] + [("means", k, c.tolist()) for k, c in enumerate(means)]
    meta += [("facts", k, [float(j), float(counted.get(k, (0, 1.0))[0]), float((part == k).sum()), float(counted.get(k, (0, 1.0))[1])]) for k, j in enumerate(parted.owner.tolist())]
    meta.append(("error", 0, [error]))
    meta += [(f"book{j}", k, c.tolist()) for j, bk in enumerate(books) for k, c in enumerate(bk)]
    spark.createDataFrame(meta, "part string, k int, v array<double>").coalesce(1).write.parquet(f"{path}/meta")
    return True


class Index:
    """Centroids, means and codebooks of a built index: at most 256 + 2 * 256 * PARTS + 16 * 256 vectors, whatever the number of rows."""

    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/meta").toPandas()
        get = lambda part: np.stack(meta[meta["part"] == part].sort_values("k")["v"].to_numpy())
        owner, self.sizes, seen, self.near = get("facts").T
        self.error = float(get("error")[0, 0])
        self.parted = Cells(get("cells"), get("parts"), owner.astype(np.int64))
        self.means = get("means")
        self.books = [get(f"book{j}") for j in range(len({p for p in meta["part"] if p.startswith("book")}))]
        dim = self.means.shape[1]
        self.edges = np.linspace(0, dim, len(self.books) + 1).astype(int)
        # rows are of length 1, so what their mean lacks to that is their spread; small samples understate it
        spread = (1 - (self.means**2).sum(axis=1)) * seen / np.maximum(seen - 1, 1)
        spread[seen < 2] = np.median(spread[seen >= 2]) if (seen >= 2).any() else 1.0
        self.deviation = np.sqrt(np.maximum(spread, 1e-3) / dim)
        self.n = int(self.sizes.sum())

    def decoded(self, part: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes of a part's rows stand for."""
        return self.parted.parts[part] + np.concatenate([bk[codes[:, j]] for j, bk in enumerate(self.books)], axis=1)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """(query, part): the largest similarity that a row of the part can have, by its angle to the part's centroid and that of the part's farthest row."""
        between = np.arccos(np.clip(q @ self.parted.parts.T, -1, 1)) - np.arccos(np.clip(self.near, -1, 1))
        return np.cos(np.maximum(between, 0)) + 1e-6

    def chosen(self, q: np.ndarray, k: int, nprobes: int = NPROBES, target: float = TARGET) -> np.ndarray:
        """(query, part): which parts each query reads.

        The likely similarity of its k-th neighbour is where the parts together hold k rows above; parts are read in
        order of the share of their rows above it until they hold target of those rows, or the most rows that nprobes allows."""
        if len(q) > CHOSEN:
            return np.concatenate([self.chosen(q[a : a + CHOSEN], k, nprobes, target) for a in range(0, len(q), CHOSEN)])
        middle, most = q @ self.means.T, nprobes * self.n / min(len(self.parted.cells), CELLS)
        low, high = np.full(len(q), -1.0), np.full(len(q), 1.0)
        for _ in range(25):
            at = (low + high) / 2
            above = (self.sizes * _upper_tail((at[:, None] - middle) / self.deviation)).sum(axis=1) > k
            low, high = np.where(above, at, low), np.where(above, high, at)
        share = _upper_tail((low[:, None] - middle) / self.deviation)
        order = np.argsort(-share, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(share * self.sizes, order, 1), axis=1)
        read = np.cumsum(self.sizes[order], axis=1)
        before = np.concatenate((np.zeros((len(q), 1)), held[:, :-1]), axis=1)
        take = (before < target * held[:, -1:]) & (read <= np.maximum(most, read[:, :1]))
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, 1)
        return out & (self.sizes > 0)


def search(
    spark: SparkSession, path: str, vector: list[float], k: int = 5, *, nprobes: int = NPROBES, source: str | None = None, min_time: float | None = None, exact: bool = False
) -> DataFrame:
    """(id, distance) of one query: filters hold before ranking."""
    from brindle.operators.search import prefilter

    query = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, query_vector array<double>")
    found = search_many(spark, path, query, k, nprobes=nprobes, rows=lambda r: prefilter(r, source, min_time), exact=exact)
    return found.select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id")


def search_many(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, *, nprobes: int = NPROBES, target: float = TARGET, rows: Callable[[DataFrame], DataFrame] = lambda r: r, exact: bool = False
) -> DataFrame:
    """(query_id, id, distance, rank) for queries (query_id, query_vector), in blocks of bounded size, each ended by a table.

    The codes of the parts that a query reads tell how near its k-th row is; all rows within MARGIN deviations of the codes'
    error get exact distances in double precision, ties by id, so answers do not depend on files or batches. exact: parts
    that can hold a nearer row than the k-th one found are read besides, whole, so that none is missed. rows filters the
    index's rows before that."""
    from brindle.operators.search import query_blocks
    from brindle.operators.store import union

    ship_package(spark)
    index, held = Index(spark, path), rows(spark.read.parquet(f"{path}/rows"))
    found = []
    for qid, q in query_blocks(queries):
        one = _search_block(index, held, qid, q, k, nprobes, target, exact)
        found = [*(materialize(x, "ann-block") if not hasattr(x, "_brindle_path") else x for x in found), one]
    if not found:
        return held.select(F.lit(None).cast("long").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where(F.lit(False))
    return union(found)


def _chosen(spark: SparkSession, index: Index, q: np.ndarray, k: int, nprobes: int, target: float) -> np.ndarray:
    """Index.chosen(), by tasks: a bit for each of a block's queries and each part comes back."""
    if len(q) <= CHOSEN:
        return index.chosen(q, k, nprobes, target)
    held = spark.sparkContext.broadcast((index, q))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, q = held.value
        for pdf in frames:
            for at in pdf["id"]:
                bits = np.packbits(index.chosen(q[at : at + CHOSEN], k, nprobes, target))
                yield pd.DataFrame({"at": [at], "bits": [bits.tobytes()]})

    got = {r.at: r.bits for r in spark.range(0, len(q), CHOSEN, numPartitions=min(-(-len(q) // CHOSEN), 64)).mapInPandas(run, "at long, bits binary").collect()}
    parts, out = len(index.parted.parts), np.zeros((len(q), len(index.parted.parts)), bool)
    for at, bits in got.items():
        n = min(CHOSEN, len(q) - at)
        out[at : at + n] = np.unpackbits(np.frombuffer(bits, np.uint8))[: n * parts].reshape(n, parts)
    return out


def _search_block(index: Index, rows: DataFrame, qid: np.ndarray, q: np.ndarray, k: int, nprobes: int, target: float, exact: bool) -> DataFrame:
    spark = rows.sparkSession
    chosen, id_type = _chosen(spark, index, q, k, nprobes, target), rows.schema["id"].dataType.simpleString()

    def within(parts: np.ndarray) -> DataFrame:
        """Rows of the parts; others are not read."""
        cells = sorted({int(index.parted.owner[p]) for p in parts})
        return rows.where(F.col("ivf_cell").isin(cells) & F.col("part").isin([int(p) for p in parts]))

    # tables of at most QUERY_BLOCK queries
    held = spark.sparkContext.broadcast((index, chosen, q))

    def kth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, chosen, q = held.value
        best = np.full((len(q), k), -np.inf)
        for pdf in frames:
            for part, own in pdf.groupby("part"):
                who = np.flatnonzero(chosen[:, int(part)])
                if len(who):
                    near = np.concatenate((best[who], q[who] @ index.decoded(int(part), np.stack(own["pq_code"].to_numpy())).T), axis=1)
                    best[who] = np.partition(near, near.shape[1] - k, axis=1)[:, -k:]
        at, _ = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"q": at, "near": best[np.isfinite(best)]})

    asked = np.flatnonzero(chosen.any(axis=0))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near")))
    # the k-th similarity by codes: one row for each query that has so many
    ends = within(asked).select("pq_code", "part").mapInPandas(kth, "q long, near double").withColumn("r", rank).where(F.col("r") == k).select("q", "near").collect()
    least = np.full(len(q), -np.inf)
    for r in ends:
        least[r.q] = r.near - MARGIN * index.error
    found = _exact_block(within(asked), id_type, index, qid, q, k, chosen, least)
    if not exact:
        return found
    found = materialize(found, "ann-likely")
    last = np.full(len(q), -1.0)
    place = {int(x): i for i, x in enumerate(qid)}
    for r in found.where(F.col("rank") == k).select("query_id", "distance").collect():  # a row for each query
        last[place[r.query_id]] = 1 - r.distance
    able = (index.reach(q) >= last[:, None]) & (index.sizes > 0)
    rest = _exact_block(within(np.flatnonzero(able.any(axis=0))), id_type, index, qid, q, k, able, np.full(len(q), -np.inf))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.unionByName(rest).dropDuplicates(["query_id", "id"]).withColumn("rank", again).where(F.col("rank") <= k)


def _nearest(some: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, distance), the k nearest of each query, ties by id."""
    who, ids, far = map(np.concatenate, zip(*some))
    order = np.lexsort((ids, far, who))
    who, ids, far = who[order], ids[order], far[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], ids[keep], far[keep]


def _exact_block(rows: DataFrame, id_type: str, index: Index, qid: np.ndarray, q: np.ndarray, k: int, read: np.ndarray, least: np.ndarray) -> DataFrame:
    """(query_id, id, distance, rank): of the rows in the parts that each query reads and whose codes are no farther than its least similarity, the k nearest."""
    held = rows.sparkSession.sparkContext.broadcast((index, qid, q, read, least))

    def exactly(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, qid, q, read, least = held.value
        asked = (q != 0).any(axis=1)
        for pdf in frames:
            held_, pairs = [], 0
            for part, own in pdf.groupby("part"):
                who = np.flatnonzero(read[:, int(part)] & asked)
                if not len(who):
                    continue
                x = np.stack(own["vector"].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(x, axis=1)
                near = q[who] @ index.decoded(int(part), np.stack(own["pq_code"].to_numpy())).T
                a, b = np.nonzero((near >= least[who][:, None]) & (norms > 0))
                held_.append((who[a], own["id"].to_numpy()[b], 1 - np.einsum("ij,ij->i", x[b], q[who[a]]) / norms[b]))
                pairs += len(a)
                if pairs > PAIRS:
                    held_ = [_nearest(held_, k)]
                    pairs = 0
            if held_:
                who, ids, far = _nearest(held_, k)
                yield pd.DataFrame({"query_id": qid[who], "id": ids, "distance": far})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    found = rows.select("id", "part", "pq_code", "vector").mapInPandas(exactly, f"query_id long, id {id_type}, distance double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def read_share(spark: SparkSession, path: str, queries: DataFrame, k: int, *, nprobes: int = NPROBES, target: float = TARGET) -> float:
    """The mean share of an index's rows in the parts that a query reads."""
    from brindle.operators.search import query_blocks

    ship_package(spark)
    index, total, n = Index(spark, path), 0.0, 0
    for qid, q in query_blocks(queries):
        total += float((_chosen(spark, index, q, k, nprobes, target) @ index.sizes).sum())
        n += len(qid)
    return total / (n * index.n) if n else 0.0


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_wanted, n_found, recall): of the exact neighbours (query_id, id), how many were found. One row."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_wanted"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_wanted"))
