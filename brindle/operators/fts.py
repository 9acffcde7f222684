"""Full-text search: postings, corpus statistics and BM25 (Robertson & Zaragoza, 2009).

Stored postings lie in blocks, one for each term and window, a window being some hundred texts of like length of one input partition. A block
says the most that a text in it can add to a score, but for the term's weight, at the average length of the index's own
texts (Ding & Suel, 2011); where a corpus's average is larger, no text adds more than so many times that. A search sums these bounds for each window, scores the most promising
windows, and then reads only those windows that can still reach the best k.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.functions.scalars import terms
from brindle.session import materialize, ship_package

log = logging.getLogger("brindle.fts")

K1, B = 1.2, 0.75
#: Texts of a window at most; windows that are scored first; windows that are named in a filter and not joined, at most.
WINDOW, SEEDS, NAMED = 512, 16, 1000
#: Tasks that a term's blocks are dealt over at most.
SLOTS = 16
#: Bytes of words that a task sorts into blocks at once, and blocks that it hands on at once; steps of a block's bound.
PACK, GIVEN = 16 << 20, 100_000
STEPS = 1024
BLOCKS = "term string, window long, n int, most double, held array<struct<doc: long, tf: int, length: int>>"
#: Blocks as they are shuffled, and a posting in them; tf is below zero where doc is null.
PACKED, POSTING = "term string, window long, most double, packed binary", np.dtype([("doc", "<i8"), ("tf", "<i4"), ("length", "<i4")])


def postings(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf, length): one row for each term of each text, split once; runs of the sorted terms give tf, without a shuffle."""
    rows = docs.select(F.col(id_).alias("id"), F.sort_array(terms(F.col(text))).alias("ts")).where(F.size("ts") > 0)
    head = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.get("ts", i - 1) != F.get("ts", i - 2)))
    rows = rows.select("id", "ts", F.size("ts").alias("length"), head.alias("heads"))
    ends = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.col("length") + 1))
    runs = F.zip_with("heads", ends, lambda a, b: F.struct(F.get("ts", a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.select("id", "length", F.explode(runs).alias("x")).select("id", "x.term", "x.tf", "length")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n, avg_length): one row; a null text has no terms."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size(terms(F.col(text))), F.lit(0))).alias("avg_length"))


def document_frequencies(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def _places(column: str, term: str) -> Column:
    """How often a list holds a term."""
    return F.size(F.filter(column, lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, query: str, *, id_: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, relevance) of the texts with a term of the query, one row for each such text.

    Each text is split once, into its length and the counts of the query's terms, which are kept as a narrow table; one
    aggregate over it gives number, average length and each term's frequency, and the scores then are an expression on
    each row, so no text is shuffled. Use search_blocks where blocks are stored."""
    wanted = query_terms(query)
    rows = docs.select(F.col(id_).alias("id"), terms(F.col(text)).alias("ts"))
    if not wanted:
        return rows.select("id", F.lit(0.0).alias("relevance")).where(F.lit(False))
    own = rows.select("id", F.coalesce(F.size("ts"), F.lit(0)).alias("length"), F.filter("ts", lambda x: x.isin(wanted)).alias("own"))
    counted = materialize(own.select("id", "length", *[_places("own", t).alias(f"tf{k}") for k, t in enumerate(wanted)]), "bm25")
    df = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]
    # one row
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"), *df)
    hits = counted.where(reduce(add, [F.col(f"tf{k}") for k in range(len(wanted))]) > 0)
    parts = [_weight(F.col(f"tf{k}"), F.col(f"df{k}"), k1, b) for k in range(len(wanted))]
    return hits.crossJoin(F.broadcast(stats)).select("id", reduce(add, parts).alias("relevance"))


def bm25_indexed(postings_: DataFrame, stats: DataFrame, query: str, *, k1: float = K1, b: float = B) -> DataFrame:
    tf = postings_.where(F.col("term").isin(query_terms(query)))
    return _score(tf, document_frequencies(tf), stats, k1, b)


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column | np.ndarray, length: Column | np.ndarray, average: Column | float, k1: float, b: float) -> Column | np.ndarray:
    """Grows with tf and falls with length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def _weight(tf: Column, df: Column, k1: float, b: float) -> Column:
    return _idf(F.col("n"), df) * _saturated(tf, F.col("length"), F.col("avg_length"), k1, b)


def _score(tf: DataFrame, df: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    # one row for each query term, and one row of statistics
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    return rows.groupBy("id").agg(F.sum(_weight(F.col("tf"), F.col("df"), k1, b)).alias("relevance"))


# ---- blocks --------------------------------------------------------------------------------------------------------------


def _packs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in packs of about ``most`` bytes of column 1; a longer text ends its pack. Rows with an empty or null text are left out."""
    held, size = [], 0
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater(pc.binary_length(batch.column(1)), 0), False))
        upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = int(upto[begin - 1]) if begin else 0
            end = min(batch.num_rows, int(np.searchsorted(upto, before + most - size)) + 1)
            held.append(batch.slice(begin, end - begin))
            begin, size = end, size + int(upto[end - 1]) - before
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _blocks_of(pack: pa.RecordBatch, first: int, window: int, average: float) -> tuple[pa.RecordBatch, int]:
    """(blocks, number of windows) of a pack (id, joined terms); its texts, shortest first, fill the windows first, first + 1, ...

    Blocks stand in the order of window and term and their bounds are rounded up to STEPS-ths, so that they compress well."""
    split = pc.split_pattern(pack.column(1), " ")
    at = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    length, known = np.diff(at).astype(np.int64), len(coded.dictionary)
    sort = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(known, np.int64)
    rank[sort.to_numpy()] = np.arange(known)
    term = rank[coded.indices.to_numpy()]
    # of texts of like length, those that share the rarest term are neighbours, so that fewer windows hold it
    often = np.bincount(term, minlength=known)
    rarity = np.where(often > 1, often * known + np.arange(known), np.iinfo(np.int64).max)
    order = np.lexsort((np.minimum.reduceat(rarity[term], at[:-1] - at[0]), np.floor(np.log2(length + 1))))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(place, length)
    # equal keys are a term's occurrences in a text, and neighbours those in the window
    key = (owner // window * known + term) * window + owner % window
    key.sort()
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf, (block, inside) = np.diff(np.append(head, len(key))), np.divmod(key[head], window)
    begin = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    n = np.diff(np.append(begin, len(head)))  # postings of each block
    number, code = np.divmod(block[begin], known)
    doc = order[np.repeat(number, n) * window + inside]
    size, ids = length[doc], pack.column(0)
    made = np.empty(len(head), POSTING)
    made["doc"], made["length"] = pc.fill_null(ids, 0).to_numpy()[doc], size
    made["tf"] = np.where(ids.is_valid().to_numpy(zero_copy_only=False)[doc], tf, -tf) if ids.null_count else tf
    at = pa.array(POSTING.itemsize * np.append(begin, len(head)), pa.int32())
    packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, at.buffers()[1], pa.py_buffer(made.tobytes())])
    most = np.ceil(np.maximum.reduceat(_saturated(tf, size, average, K1, B), begin) * STEPS) / STEPS
    columns = [coded.dictionary.take(sort.take(pa.array(code))), pa.array(number + first, pa.int64()), pa.array(most, pa.float64()), packed]
    return pa.RecordBatch.from_arrays(columns, names=["term", "window", "most", "packed"]), -(-len(order) // window)


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """PACKED rows as BLOCKS."""
    packed = batch.column(3).cast(pa.binary())
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    made = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(POSTING)
    at = (at - at[0]) // POSTING.itemsize
    each = [pa.array(np.ascontiguousarray(made["doc"]), mask=made["tf"] < 0), pa.array(np.abs(made["tf"])), pa.array(np.ascontiguousarray(made["length"]))]
    held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(each, names=["doc", "tf", "length"]))
    columns = [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int32()), batch.column(2), held]
    return pa.RecordBatch.from_arrays(columns, names=["term", "window", "n", "most", "held"])


def build_blocks(rows: DataFrame, path: str, *, id_: str = "_key", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[int, int]:
    """Write blocks and the texts' lengths (with the columns to keep for filters) to path, which must be new: (texts, terms in all).

    ids are whole numbers. Null texts count as texts without terms. Each task sorts its own texts' terms into whole
    blocks, so blocks are shuffled and not postings. The blocks of a term, however frequent, are dealt over SLOTS tasks
    and sorted by term, so that a search for it reads few row groups."""
    spark = rows.sparkSession
    ship_package(spark)
    length = F.coalesce(F.size(terms(F.col(text))), F.lit(0)).alias("length")
    rows.select(F.col(id_).alias("doc"), length, *keep).write.parquet(f"{path}/docs")
    texts, total = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    average, window = float(total / texts if total else 1.0), WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.operators.fts import _blocks_of, _packs

        number = TaskContext.get().partitionId() << 32
        for pack in _packs(batches, PACK):
            made, windows = _blocks_of(pack, number, window, average)
            number += windows
            for k in range(0, made.num_rows, GIVEN):
                yield made.slice(k, GIVEN)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.operators.fts import _unpacked

        yield from (_unpacked(batch) for batch in batches if batch.num_rows)

    joined = F.array_join(terms(F.col(text)), " ")
    blocks = rows.select(F.col(id_).cast("long").alias("doc"), joined.alias("joined")).mapInArrow(run, PACKED)
    dealt = blocks.repartition("term", F.pmod(F.xxhash64("window"), F.lit(SLOTS))).sortWithinPartitions("term", "window")
    dealt.mapInArrow(unpack, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return texts, total


def open_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(blocks, docs) of a stored index, or None where it is missing or not of its form, which is told from its files' schema alone."""
    try:
        blocks, docs = (spark.read.parquet(f"{path}/{x}") for x in ("blocks", "docs"))
    except (PySparkException, Py4JJavaError) as e:  # nothing but the files' schema is read here
        log.warning("no text index at %s: %s", path, str(e).splitlines()[0])
        return None
    if {"term", "window", "most", "held"} <= set(blocks.columns) and {"doc", "length"} <= set(docs.columns):
        return blocks, docs
    log.warning("%s holds no text index", path)
    return None


def search_blocks(
    parts: list[tuple[int, DataFrame, DataFrame, float]], loose: DataFrame | None, n: int, average: float, query: str, k: int, *,
    only: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame | None, int, int]:
    """((id, relevance), windows read, windows with a term): the k best texts by BM25, and those that equal the last in a millionth.

    parts: (number added to its ids, blocks, docs, average length of its texts) of each index. loose: texts (id, text, columns for filters) that no
    index holds; they are scored whole. n and average are of all of them. only: a filter on docs and on loose, which
    holds before ranking. None instead of rows where the query has no terms or there is nothing to search."""
    wanted = query_terms(query)
    if not wanted or not (parts or loose is not None):
        return None, 0, 0
    blocks = None
    for number, (shift, held, _, own) in enumerate(parts):
        larger = max(1.0, average / own) if own else 1.0
        one = held.where(F.col("term").isin(wanted)).withColumns({"shift": F.lit(shift), "index": F.lit(number * _APART), "most": F.col("most") * larger})
        blocks = one if blocks is None else blocks.unionByName(one)
    tf = None if loose is None else postings(loose).where(F.col("term").isin(wanted))
    counted = [x for x in (None if blocks is None else blocks.select("term", F.col("n").cast("long").alias("df")), None if tf is None else tf.select("term", F.lit(1).cast("long").alias("df"))) if x is not None]
    frequency = {r.term: r.df for r in reduce(DataFrame.unionByName, counted).groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row for each term of the query
    if not frequency:
        return None, 0, 0
    idf = F.create_map(*[x for t, df in frequency.items() for x in (F.lit(t), _idf(F.lit(n), F.lit(df)))])[F.col("term")]
    weight = lambda tf, length: idf * _saturated(tf, length, F.lit(float(average)), K1, B)

    scored = []
    if tf is not None:
        own = tf if only is None else tf.join(only(loose).select("id"), "id", "left_semi")
        scored.append(own.groupBy("id").agg(F.sum(weight(F.col("tf"), F.col("length"))).alias("relevance")))
    if blocks is None:
        return scored[0].orderBy(F.desc("relevance"), "id").limit(k), 0, 0

    allowed = None
    if only is not None:
        allowed = reduce(DataFrame.unionByName, [only(docs).select((F.col("doc") + F.lit(shift)).alias("id")) for shift, _, docs, _ in parts])

    def score(some: DataFrame) -> DataFrame:
        each = some.select("term", "shift", F.explode("held").alias("x")).select("term", (F.col("x.doc") + F.col("shift")).alias("id"), "x.tf", "x.length")
        each = each if allowed is None else each.join(allowed, "id", "left_semi")
        return each.groupBy("id").agg(F.sum(weight(F.col("tf"), F.col("length"))).alias("relevance"))

    code = (F.col("index") + F.col("window")).alias("code")
    # a rounding error more, so that a bound is never below what it bounds
    bounds = blocks.select(code, (idf * F.col("most") * (1 + 1e-12)).alias("most")).groupBy("code").agg(F.sum("most").alias("most"))
    named = lambda codes: blocks.where(F.col("window").isin(sorted({c % _APART for c in codes})) & code.isin(codes))
    seeds = [r.code for r in bounds.orderBy(F.desc("most"), "code").limit(SEEDS).collect()]
    best = reduce(DataFrame.unionByName, [*scored, score(named(seeds))]).orderBy(F.desc("relevance")).limit(k).collect()
    least = best[-1].relevance - 1e-6 if len(best) == k else -1.0
    able = bounds.where(F.col("most") >= F.lit(least))
    total, reads = bounds.agg(F.count(F.lit(1)), F.count_if(F.col("most") >= F.lit(least))).first()
    if reads <= NAMED:
        some = named([r.code for r in able.select("code").collect()])
    else:
        some = blocks.withColumn("code", code).join(able.select("code"), "code", "left_semi").drop("code")
    whole = reduce(DataFrame.unionByName, [*scored, score(some)])
    return whole.where(F.col("relevance") >= F.lit(least)), reads, total


#: What the windows of several indexes are told apart by; they are below it.
_APART = 1 << 56
