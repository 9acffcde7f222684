"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors with the same components fall together first and count with their number. Each table's sign bits make buckets;
a bucket above BLOCK vectors is dealt into blocks, and every pair of blocks is one group of bounded size, so that no
pair of a bucket is left out and no group is unbounded. A vector goes to each of its groups once, in the precision that it
was given in, with its packed signs; groups are large and tables few, as what is shuffled follows the tables. In a group
all cosines come from matrix products in double precision, STRIP rows at a time. A pair that meets in several tables is
counted in the first of them only. Groups return numbers of links and, of each connected part, a star to its smallest id:
rows in proportion to the vectors, not to the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.components import connected_components
from brindle.llm.skew import salted_join
from brindle.session import discard, materialize, ship_package

BLOCK = 8192
#: Vectors that a bucket holds on average, if they were spread evenly. From 5,000 vectors on fewer cosines are then told
#: than all pairs have; larger buckets need fewer tables, so less is shuffled, but more is computed.
BUCKET = 512
#: Rows whose cosines to a whole group are held at once.
STRIP = 256
#: Up to so many crowded buckets (some numbers each) are broadcast.
BROADCAST_BUCKETS = 500_000


def plan(n: int, cosine: float, miss: float = 1e-4) -> tuple[int, int]:
    """(bits of a table, tables) for n vectors, so that a pair at the cosine meets in no table with probability miss at most."""
    bits = min(28, max(2, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - alike)))


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(dim * 1009 + count).standard_normal((dim, count))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the width dim, scaled to length 1 in double precision, and which rows are usable; others are zero."""
    n = len(column)
    out, ok = np.zeros((n, dim)), np.zeros(n, bool)
    lengths = column.value_lengths().fill_null(-1).to_numpy()
    right = lengths == dim
    if right.any():
        flat = column.filter(pa.array(right)).flatten()
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        largest = np.abs(values).max(axis=1, initial=0)
        usable = np.isfinite(largest) & (largest > 0)
        scaled = values[usable] / largest[usable, None]
        rows = np.flatnonzero(right)[usable]
        out[rows] = scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]
        ok[rows] = True
    return out, ok


def block_links(
    ids: np.ndarray, weights: np.ndarray, x: np.ndarray, signs: np.ndarray, table: int, side: np.ndarray | None, cosine: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links, smallest id of its connected part) of the rows with links in one group.

    signs: (rows, tables) numbers. side: None for all pairs of the rows, else pairs between the two sides only. links: weights
    of linked rows of pairs that no earlier table has."""
    a = np.arange(len(ids)) if side is None else np.flatnonzero(~side)
    b = a if side is None else np.flatnonzero(side)
    links, linked = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    # roots by rank of the id, so that the smallest rank of a part is that of its smallest id
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root, other = np.arange(len(ids)), x[b].T
    for k in range(0, len(a), STRIP):
        rows = a[k : k + STRIP]
        near = x[rows] @ other >= cosine
        if side is None:
            near[np.arange(len(rows)), k + np.arange(len(rows))] = False
        p, q = np.nonzero(near)
        if not len(p):
            continue
        u, v = rows[p], b[q]
        linked[u] = linked[v] = True
        fresh = np.flatnonzero(signs[u, 0] != signs[v, 0]) if table else np.arange(len(u))
        for t in range(1, table):
            fresh = fresh[signs[u[fresh], t] != signs[v[fresh], t]]
        links += np.bincount(u[fresh], weights[v[fresh]], len(ids)).astype(np.int64)
        if side is not None:
            links += np.bincount(v[fresh], weights[u[fresh]], len(ids)).astype(np.int64)
        low, high = rank[u], rank[v]
        while True:
            low, high = root[low], root[high]
            apart = low != high
            if not apart.any():
                break
            low, high = low[apart], high[apart]
            np.minimum.at(root, np.maximum(low, high), np.minimum(low, high))
            while (root[root] != root).any():
                root = root[root]
    at = np.flatnonzero(linked)
    return at, links[at], ids[order[root[rank[at]]]]


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding array<float|double>, ...), one row each.

    Rows whose embedding is null, empty, zero, or holds null or non-finite components link with nothing. Vectors of
    another width than the commonest one (the smaller at a tie) link with none of it; each width is compared on its own.
    Rows that repeat a vec_id count as one, with the embedding that sorts first; a null vec_id is left out. Other columns are ignored."""
    spark = vectors.sparkSession
    ship_package(spark)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kept_as = "array<float>" if single else "array<double>"
    base = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept_as).alias("embedding"))
    base = base.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda e: e != 0)
    # -0.0 counts as 0.0
    keyed = base.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("embedding", F.transform("embedding", lambda e: e + F.lit(0.0)))
    keyed = keyed.withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(7), "embedding"))
    groups = keyed.where("fine").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    fine_rows = salted_join(keyed.where("fine").select("vec_id", "a", "b"), groups, ["a", "b"]).select("vec_id", "rep", "weight", F.lit(True).alias("fine"))
    odd = keyed.where(~F.col("fine")).select("vec_id", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("weight"), F.lit(False).alias("fine"))
    of = materialize(fine_rows.unionByName(odd), "vecs")
    reps = materialize(
        of.where("fine and vec_id = rep").select("vec_id", "weight").hint("merge").join(base.hint("merge"), "vec_id").select("vec_id", "weight", "embedding", F.size("embedding").alias("width")),
        "distinct",
    )
    # one row for each width, of which embedders give few
    widths = [r[0] for r in reps.groupBy("width").count().orderBy("width").collect()]
    parts = [_of_width(reps.where(F.col("width") == w).drop("width"), w, cosine, miss) for w in widths]
    if not parts:
        return of.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    found = materialize(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("id").alias("u"), F.col("label").alias("v")))
    known = counts.hint("merge").join(labels.hint("merge"), "id", "left").withColumnRenamed("id", "rep")
    out = salted_join(of, known, ["rep"], "left")
    return out.select(
        "vec_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "rep")).alias("kept"),
    )


def _of_width(reps: DataFrame, dim: int, cosine: float, miss: float) -> DataFrame:
    """(id, links, label) rows, several for an id, of distinct vectors (vec_id, weight, embedding) of one width."""
    bits, tables = plan(reps.count(), cosine, miss)
    single = reps.schema["embedding"].dataType.elementType.typeName() == "float"
    held_as = np.dtype("<f4" if single else "<f8")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, powers = hyperplanes(dim, bits * tables), 1 << np.arange(bits)
        for batch in batches:
            x, _ = unit_rows(batch.column(2), dim)
            up = x @ planes > 0
            slots = (up.reshape(-1, tables, bits) * powers).sum(axis=2).astype(np.int32)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            given = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(held_as).reshape(len(x), dim)
            columns = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in given], pa.binary()), pa.array([r.tobytes() for r in np.packbits(up, axis=1)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, pa.array(slots.ravel()))], names=["vec_id", "weight", "x", "bits", "slots"])

    signed = materialize(reps.mapInArrow(sign, "vec_id long, weight long, x binary, bits binary, slots array<int>"), "signed")
    slots = signed.select("vec_id", F.posexplode("slots").alias("t", "s"))
    crowded = slots.groupBy("t", "s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("t", "s", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    crowded = materialize(crowded, "crowded")
    few = crowded.count() <= BROADCAST_BUCKETS
    rows = signed.select("vec_id", "weight", "x", "bits", F.posexplode("slots").alias("t", "s")).join(F.broadcast(crowded) if few else crowded.hint("merge"), ["t", "s"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), own.alias("mine")))
    dealt = rows.select("vec_id", "weight", "x", "bits", "t", "s", F.explode(pair).alias("p")).select("vec_id", "weight", "x", "bits", "t", "s", "p.i", "p.j", "p.mine")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 or (held and held[0].num_rows > 1):
                whole = pa.Table.from_batches(held).combine_chunks()
                t, _, i, j = key
                ids, weights = whole["vec_id"].to_numpy(), whole["weight"].to_numpy()
                x = np.frombuffer(b"".join(whole["x"].to_pylist()), held_as).astype(np.float64).reshape(len(ids), dim)
                x /= np.abs(x).max(axis=1)[:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                packed = np.frombuffer(b"".join(whole["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
                signs = np.unpackbits(packed, axis=1, count=bits * tables).reshape(len(ids), tables, bits)[:, :t] @ (1 << np.arange(bits))
                side = None if i == j else whole["mine"].to_numpy() == j
                at, links, label = block_links(ids, weights, x, signs, t, side, cosine)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links), pa.array(label)], names=["id", "links", "label"])

        for batch in batches:
            k4 = np.stack([batch.column(c).to_numpy() for c in ("t", "s", "i", "j")], axis=1)
            edges = np.concatenate(([0], np.flatnonzero((k4[1:] != k4[:-1]).any(axis=1)) + 1, [len(k4)])) if len(k4) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                now = tuple(int(v) for v in k4[a])
                if now != key:
                    yield from done()
                    held, key = [], now
                held.append(batch.slice(a, b - a))
        yield from done()

    return dealt.repartition("t", "s", "i", "j").sortWithinPartitions("t", "s", "i", "j").mapInArrow(compare, "id long, links long, label long")
