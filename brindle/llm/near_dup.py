"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

Plan. (1) One pass over the texts gives each document its set size, a 128-bit hash of its shingle set and its band
keys. One permutation splits the hash range into bins; the smallest hash of each bin is kept, and an empty bin borrows
from the first filled bin in a fixed random order of its own (optimal densification). (2) Documents with the same set
fall together into one representative, so thousands of copies cost one row from here on. (3) Buckets of equal band
keys send edges only from a pivot, the smallest member, to the others, never all pairs. (4) Both texts of an edge meet
in blocks of bounded size, where the full sets are compared, and components are taken. (5) Links can only be missing in
buckets that still hold several components. Where such a bucket has at most FEW members its other pairs are confirmed
like edges; larger ones are dealt into blocks, each pair of blocks is one group of bounded size, and the sizes of all its
intersections come from one product of incidence matrices; a group returns a star for each linked part, so the rows
follow the members and not their pairs. Blocks hold either members of the bucket's largest component or others, and two
blocks of the former, which are joined already, are never paired. (6) Where a bucket holds more than a block of others,
its members are grouped anew by rare shingles: two sets at the threshold share one of the first few of their shingles in
any fixed order (a prefix filter), and in an order from rare to common these groups are small. So no link is lost to the
stars, and members that have only common passages in common are never compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.components import connected_components
from brindle.llm.skew import hot_keys, salted_join
from brindle.llm.textvec import U, mix, shingle_sets
from brindle.session import discard, materialize, ship_package

#: Members of a pivot that are compared in one block.
BLOCK = 128
#: In a bucket of at most so many members that is not settled by its star, all pairs are confirmed one by one.
FEW = 4
#: Members of a block of a larger bucket; a group has two blocks.
DEALT = 256
#: Counters over which shingles are spread to tell rare from common ones (2 MB, whatever the data).
COUNTERS = 1 << 18


def bands_for(percent: int, rows: int = 6, miss: float = 1e-6) -> int:
    """So many bands that a pair at the threshold shares none with probability miss at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(percent / 100, 0.999) ** rows)))


def bin_orders(bins: int) -> np.ndarray:
    """For each bin (column) a fixed random order of all bins, from which it borrows when it is empty."""
    rng = np.random.default_rng(bins)
    return np.argsort(rng.random((bins, bins)), axis=0).astype(np.int32)


def one_permutation(found: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """The densified signature of one sorted, non-empty set of 64-bit hashes."""
    place = ((found >> U(32)) * U(bins)) >> U(32)
    head = np.concatenate(([True], place[1:] != place[:-1]))
    signature, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    at = place[head].astype(np.int64)
    signature[at], filled[at] = found[head], True
    if len(at) < bins:
        empty = np.flatnonzero(~filled)
        tries = filled[orders[:, empty]]
        signature[empty] = signature[orders[np.argmax(tries, axis=0), empty]]
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = mix(signature).reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)
    for k in range(rows):
        key = mix(key ^ parts[:, k])
    return key.astype(np.int64)


def signatures(docs: DataFrame, *, shingle: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) for docs (doc_id, text); a text without words has no bands."""
    ship_package(docs.sparkSession)
    bins = bands_for(percent, rows) * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = bin_orders(bins)
        for batch in batches:
            n = batch.num_rows
            size, a, b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            bands: list = [None] * n
            for k, found in shingle_sets(batch.column(1), shingle):
                size[k] = len(found)
                if len(found):
                    a[k], b[k] = found.sum().astype(np.int64), mix(found ^ U(0x5851F42D4C957F2D)).sum().astype(np.int64)
                    bands[k] = band_keys(one_permutation(found, bins, orders), rows)
            flat = [x for x in bands if x is not None]
            at = np.zeros(n + 1, np.int32)
            np.cumsum([0 if x is None else len(x) for x in bands], out=at[1:])
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(a), pa.array(b), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(pivot, member, linked) for pairs (pivot, member): the full shingle sets compared, 100 * both >= percent * either.

    A pivot's members are dealt into blocks; each block gets the pivot's text once."""
    sizes = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select("pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.hint("merge").join(sizes.hint("merge"), "pivot").select("pivot", F.col("member").alias("id"), F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("block"))
    own = sizes.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    wanted = dealt.unionByName(own)
    rows = wanted.hint("merge").join(texts.hint("merge"), "id").select("pivot", "block", "id", "text")
    pct = int(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot_set, out = None, None, ([], [], [])
        waiting: list[tuple[int, np.ndarray]] = []

        for batch in batches:
            pivots, blocks, ids = (batch.column(k).to_numpy() for k in range(3))
            for k, found in shingle_sets(batch.column(3), shingle):
                if key != (pivots[k], blocks[k]):
                    key, pivot_set = (pivots[k], blocks[k]), None
                if ids[k] == pivots[k]:
                    pivot_set = found
                    continue
                if pivot_set is None:
                    raise RuntimeError("the pivot must come first in its block")
                small, large = (found, pivot_set) if len(found) < len(pivot_set) else (pivot_set, found)
                linked = False
                if 100 * len(small) >= pct * len(large) and len(small):
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    linked = 100 * both >= pct * (len(small) + len(large) - both)
                out[0].append(pivots[k]), out[1].append(ids[k]), out[2].append(linked)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["pivot", "member", "linked"])
            out = ([], [], [])

    near = rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("id") != F.col("pivot"), "id")
    return near.mapInArrow(run, "pivot long, member long, linked boolean")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id, text, ...), one row for each input row.

    component_id is the smallest doc_id that links reach; kept is true where that is the document itself. Documents
    without words have no shingles and link with nothing. Rows that repeat a doc_id count as one document, with the
    text that sorts first, nulls last; a null doc_id is left out. Other columns are ignored. An empty table gives an empty result."""
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(base, shingle=shingle, percent=percent, rows=rows), "signatures")
    repeats = signed.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        base = materialize(base.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
        discard(signed)
        signed = materialize(signatures(base, shingle=shingle, percent=percent, rows=rows), "signatures")
    key = ["n_shingles", "set_a", "set_b"]
    groups = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    # thousands of copies have one key
    with_rep = salted_join(signed.drop("bands"), groups, key, "left", spread=["doc_id"])
    of = materialize(with_rep.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "reps")

    # buckets of representatives; those with one member are gone at once
    reps = of.where("doc_id = rep").select("doc_id")
    keyed = signed.select("doc_id", "bands").hint("merge").join(reps.hint("merge"), "doc_id").select(F.explode("bands").alias("bucket"), "doc_id")
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = materialize(keyed.hint("merge").join(full.hint("merge"), "bucket").select("bucket", "doc_id"), "buckets")
    discard(signed)

    n_rows = buckets.count()
    low = buckets.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n"))
    starred = salted_join(buckets, low.select("bucket", "pivot"), ["bucket"], spread=["doc_id"], hot=hot_keys(low, ["bucket"], n_rows, "n"))
    stars = starred.where("doc_id <> pivot").select("pivot", F.col("doc_id").alias("member")).distinct()
    done = materialize(confirm(stars, base, shingle=shingle, percent=percent), "compared")
    links = done.where("linked").select(F.col("pivot").alias("u"), F.col("member").alias("v"))
    labels = materialize(connected_components(links), "labels")

    open_ = materialize(_unsettled(buckets, labels, n_rows), "unsettled")
    few = open_.where(F.col("n") <= FEW).select("bucket", "doc_id", "component_id")
    other = few.select("bucket", F.col("doc_id").alias("other"), F.col("component_id").alias("other_component"))
    pairs = few.hint("merge").join(other.hint("merge"), "bucket").where("doc_id < other and component_id <> other_component").select(F.col("doc_id").alias("pivot"), F.col("other").alias("member")).distinct()
    fresh = pairs.hint("merge").join(done.select("pivot", "member").hint("merge"), ["pivot", "member"], "left_anti")
    one_by_one = materialize(confirm(fresh, base, shingle=shingle, percent=percent), "compared")
    larger = materialize(with_largest(open_.where(F.col("n") > FEW), n_rows), "larger")
    many = F.col("n") - F.col("size") > DEALT
    grouped = larger.where(~many)
    rare = None
    if larger.where(many).limit(1).count():
        rare = materialize(rare_groups(larger.where(many), base, shingle=shingle, percent=percent), "rare")
        grouped = grouped.unionByName(with_largest(rare, rare.count()))
    in_blocks = materialize(compare_blocks(grouped, base, shingle=shingle, percent=percent), "blocks")
    more = one_by_one.where("linked").select(F.col("pivot").alias("u"), F.col("member").alias("v")).unionByName(in_blocks)
    stars_so_far = labels.select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    final = connected_components(stars_so_far.unionByName(more))
    discard(buckets, done, labels, open_, larger, one_by_one, in_blocks, *([rare] if rare else []))
    return _finish(of, final)


def _finish(of: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        out = of.withColumn("component_id", F.col("rep"))
    else:
        out = of.hint("merge").join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _unsettled(buckets: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """(bucket, doc_id, component_id, n) of the buckets of n members that hold several components; buckets has n_rows rows."""
    named = buckets.hint("merge").join(labels.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    mixed = named.groupBy("bucket").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("bucket", "n")
    hot = hot_keys(mixed, ["bucket"], n_rows, "n")
    return salted_join(named, mixed, ["bucket"], spread=["doc_id"], hot=hot).select("bucket", "doc_id", "component_id", "n")


def linked_parts(ids: np.ndarray, sets: list[np.ndarray], percent: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its linked part) of the members of one group that link within it; all pairs are compared."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what one member alone holds is in no intersection
    places = np.cumsum(count > 1) - 1
    owner, column = owner[shared], places[column[shared]]
    both, order = np.zeros((len(sets), len(sets)), np.float32), np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        x, y = np.searchsorted(column, (a, a + chunk))
        part = np.zeros((len(sets), chunk), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        both += part @ part.T
    common = both.astype(np.int64)
    near = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(near, False)
    u, v = np.nonzero(near)
    label = ids.copy()
    while len(u):
        before = label.copy()
        np.minimum.at(label, u, before[v])
        if (label == before).all():
            break
    tied = label < ids
    return ids[tied], label[tied]


def with_largest(members: DataFrame, rows: int | None = None) -> DataFrame:
    """members (bucket, doc_id, component_id, n) with top, the component with most rows of the bucket, and size, its rows.

    rows: no less than the rows of members, where that is known."""
    parts = members.groupBy("bucket", "component_id").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("size", "component_id")).alias("top")).select("bucket", F.col("top.component_id").alias("top"), F.col("top.size").alias("size"))
    hot = None if rows is None else hot_keys(parts.groupBy("bucket").agg(F.sum("size").alias("_n")), ["bucket"], rows)
    return salted_join(members, largest, ["bucket"], spread=["doc_id"], hot=hot)


def prefix(found: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which two sets at the threshold share one: the rarest of it, by counts of hashed shingles."""
    size = len(found) - -(-percent * len(found) // 100) + 1
    return found[np.lexsort((found, counts[(found % U(len(counts))).astype(np.int64)]))[:size]]


def rare_groups(members: DataFrame, docs: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(bucket, doc_id, component_id, n): members by their prefix shingles, where several components share one.

    The order of shingles is by counters over all members, which any hash collision leaves a fixed order."""
    ids = members.select("doc_id", "component_id").distinct()
    rows = materialize(ids.hint("merge").join(docs.hint("merge"), "doc_id").select("doc_id", "component_id", "text"), "crowded")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), shingle):
                held += np.bincount((found % U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "n"])

    total = rows.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[total["at"].to_numpy()] = total["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    pct = int(percent)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            keys, sizes = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int64)
            for k, found in shingle_sets(batch.column(2), shingle):
                keys.append(prefix(found, order, pct) if len(found) else found)
                sizes[k] = len(keys[-1])
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            ids_, component = (batch.column(k).to_numpy()[owner] for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(ids_), pa.array(component)], names=["bucket", "doc_id", "component_id"])

    keyed = materialize(rows.mapInArrow(split, "bucket long, doc_id long, component_id long"), "prefixes")
    mixed = keyed.groupBy("bucket").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("bucket", "n")
    hot = hot_keys(mixed, ["bucket"], keyed.count(), "n")
    return salted_join(keyed, mixed, ["bucket"], spread=["doc_id"], hot=hot).select("bucket", "doc_id", "component_id", "n")


def deal(members: DataFrame) -> DataFrame:
    """(bucket, i, j, doc_id): the groups of members, as with_largest() gives them, of at most about 2 * DEALT rows each.

    Every two members of a bucket meet in a group, but for those that are both of its largest component."""
    whole = F.col("n") <= 2 * DEALT
    few = F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("size")) / DEALT)).cast("int")
    many = F.when(whole, 0).otherwise(F.ceil(F.col("size") / DEALT)).cast("int")
    slot = F.xxhash64("doc_id")
    inner = (F.col("component_id") == F.col("top")) & (F.col("many") > 0)
    own = F.when(inner, F.col("few") + F.pmod(slot, "many")).otherwise(F.pmod(slot, "few")).cast("int")
    # a block of others meets every block but itself, whose pairs are in its other groups; a block of the largest component meets those of others
    meets = F.filter(F.sequence(F.lit(0), F.when(inner, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1), lambda k: (k != F.col("own")) | (F.col("few") + F.col("many") == 1))
    pair = F.transform(meets, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    placed = members.withColumn("few", few).withColumn("many", many).withColumn("own", own)
    return placed.select("bucket", "doc_id", F.explode(pair).alias("p")).select("bucket", "p.i", "p.j", "doc_id")


def compare_blocks(members: DataFrame, docs: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(u, v) stars of the linked parts of each group that deal() makes of members."""
    dealt = deal(members)
    rows = dealt.hint("merge").join(docs.hint("merge"), "doc_id").select("bucket", "i", "j", "doc_id", "text")
    pct = int(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                u, v = linked_parts(np.array(ids, np.int64), sets, pct)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            docs_here = batch.column(3).to_pylist()
            for k, found in shingle_sets(batch.column(4), shingle):
                if keys[k] != key:
                    yield from done()
                    key, ids, sets = keys[k], [], []
                ids.append(docs_here[k]), sets.append(found)
        yield from done()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "u long, v long")
