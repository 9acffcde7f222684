"""Resampling of documents towards a target distribution of hashed word n-grams, by importance weights (Xie et al., 2023).

An external sort-count: tasks write each text's features as a packed stream of 16-bit bucket numbers, many texts to a
row, with the words of each text beside it, from which its place in the stream follows. Buckets are counted by sorting
streams and taking run lengths; a text's weight later is the sum of its stretch of the stream of gains, by one
np.add.reduceat a row. Texts are read once; what a task holds is a group of them or a step of a long one.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.idstore import crc_shift
from brindle.llm.skew import row_numbers
from brindle.llm.textvec import GROUP_BYTES, LOWER, PUNCT, gap, groups
from brindle.session import discard, materialize, ship_package

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 5, 20, 42
#: Bytes up to which words are hashed together, one place after the other; longer ones are hashed one by one.
SHORT = 64
STREAMS = "target boolean, ids array<long>, words array<long>, n_long long, stream binary"
_NAMES = [x.split(" ")[0] for x in STREAMS.split(", ")]
_TYPES = [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]


# ---- CRC-32 of many words and of their joins ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The step of CRC-32 for each byte, and what each byte of a CRC becomes behind 0 to 255 more bytes, at ((n * 4) + place) * 256 + byte."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= np.uint32(zlib.crc32(b"\0"))
    step = step.astype(np.uint32)
    behind = np.zeros((256, 4, 256), np.uint32)
    behind[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 256):
        last = behind[n - 1]
        behind[n] = step[last & np.uint32(255)] ^ (last >> np.uint32(8))
    return step, behind.reshape(-1)


def behind(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a CRC adds to that of a longer string in which n bytes follow."""
    table = _tables()[1]
    far = n > 255
    base = np.where(far, 0, n) * 1024
    out = table[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= table[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    if far.any():
        out[far] = crc_shift(crc[far], n[far])
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = _tables()[0]
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int16), kind="stable")
    begin, n = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-n, -SHORT))  # words above SHORT bytes come first
    rising = n[::-1]
    for j in range(int(n[long]) if long < len(n) else 0):
        upto = len(n) - int(np.searchsorted(rising, j, "right"))
        now = crc[long:upto]
        crc[long:upto] = step[(now ^ raw[begin[long:upto] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(long):
        crc[k] = zlib.crc32(raw[begin[k] : begin[k] + n[k]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _spans(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word also ends at each of the edges."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~PUNCT[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    first[edges] |= inside[1:-1][edges]
    last[edges - 1] |= inside[1:-1][edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, step: int = GROUP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of texts (bytes and their offsets), text after text, and how many words each text has.

    Long texts are worked through in steps that end between words, the last two words being carried over."""
    raw = LOWER[raw]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    space = np.uint32(zlib.crc32(b" "))
    parts, words = [np.zeros(0, np.uint16)], np.zeros(len(offsets) - 1, np.int64)
    held = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    a = 0
    while a < len(raw):
        b = len(raw) if len(raw) - a <= 2 * step else gap(raw, a + step, PUNCT)
        inner = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b)] - a
        starts, ends = _spans(raw[a:b], inner)
        text = np.searchsorted(offsets, starts + a, "right") - 1
        words += np.bincount(text, minlength=len(words))
        old = len(held[0])
        crc, size, text = (np.concatenate(x) for x in zip(held, (word_crcs(raw[a:b], starts, ends), ends - starts, text)))
        n = len(crc)
        spaced = behind(np.full(n, space, np.uint32), size) ^ crc
        two, three = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        two[1:] = behind(crc[:-1], size[1:] + 1) ^ spaced[1:]
        three[2:] = behind(two[1:-1], size[2:] + 1) ^ spaced[2:]
        valid = np.ones((n, 3), bool)
        valid[:1, 1] = valid[:2, 2] = False
        valid[1:, 1] = text[1:] == text[:-1]
        valid[2:, 2] = text[2:] == text[:-2]
        found = (np.stack((crc, two, three), axis=1) % np.uint32(BUCKETS)).astype(np.uint16)
        parts.append(found[old:][valid[old:]])
        held = (crc[-2:], size[-2:], text[-2:])
        a = b
    return np.concatenate(parts), words


def features_of(words: np.ndarray) -> np.ndarray:
    """How many runs of one to three words so many words have."""
    return words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)


# ---- streams, counts, weights ------------------------------------------------------------------------------------------


def _streams(texts: DataFrame, target: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.resample import LEAST_WORDS, feature_buckets

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, raw, offsets in groups(batch.column(1)):
                stream, words = feature_buckets(raw, offsets)
                some = ids[a:b]
                n_long = sum(i is not None and w >= LEAST_WORDS for i, w in zip(some, words.tolist()))
                cols = ([target], [some], [words.tolist()], [n_long], [stream.astype("<u2").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return texts.mapInArrow(run, STREAMS)


def _counts(streams: DataFrame) -> np.ndarray:
    """(2, BUCKETS): how often each bucket occurs in the documents' streams and in the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for target, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.sort(np.frombuffer(raw.as_buffer(), "<u2"), kind="stable")
                if len(s):
                    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    total[int(target), s[at]] += np.diff(np.append(at, len(s)))
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[kind, bucket], pa.int64())], names=["kind", "bucket", "n"])

    found = streams.select("target", "stream").mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((2, BUCKETS), np.int64)
    for r in found.collect():  # two rows a bucket at most
        out[r.kind, r.bucket] = r.n
    return out


def gains_of(counts: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, in doubles."""
    s, t = counts
    all_s, all_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def chance(doc_id: int, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)), u being told by a hash of the id: a Gumbel variable in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for docs (doc_id, text, ...) against the texts of target (text, ...).

    One row for each input row. Of the N rows with at least LEAST_WORDS words and a doc_id, the floor(percent N / 100) with
    the highest scores are drawn and ranked from 1, ties to the smaller doc_id; the rank of all others is null. Rows that
    repeat a doc_id are documents of their own with their own ranks. A null doc_id has features and a weight, but no
    score, and is never drawn. Null and empty texts have no features and weight 0. An empty target or no documents are
    counts of 0; an empty table gives no rows. Other columns are ignored. Only counts of buckets meet on the driver."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string"))
    streams = materialize(_streams(texts, False).unionByName(_streams(aim, True)), "resample-streams")
    gains = gains_of(_counts(streams))
    drawn = (streams.where("not target").agg(F.sum("n_long")).first()[0] or 0) * percent // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.resample import chance, features_of

        for batch in batches:
            for ids, words, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n = features_of(np.array(words, np.int64))
                weight, held = np.zeros(len(n), np.int64), n > 0
                if held.any():
                    weight[held] = np.add.reduceat(gains[np.frombuffer(raw.as_buffer(), "<u2")], (np.cumsum(n) - n)[held])
                score = [None if i is None else w + chance(i, seed) for i, w in zip(ids, weight.tolist())]
                cols = (ids, n, weight, score, words)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_features", "weight", "score", "words"])

    weighed = streams.where("not target").select("ids", "words", "stream").mapInArrow(run, "doc_id long, n_features long, weight long, score long, words long")
    scored = materialize(weighed, "resample-scores")
    discard(streams)
    entitled = (F.col("words") >= LEAST_WORDS) & F.col("doc_id").isNotNull()
    places = row_numbers(scored.where(entitled), [], [F.desc("score"), F.col("doc_id")], "resample-ranks")
    ranked = places.withColumn("rank", F.when(F.col("row") < drawn, F.col("row") + 1)).drop("row")
    return ranked.unionByName(scored.where(~entitled).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
