"""Content-addressed store of token ids.

Layout below one folder: ``store/kind=1`` holds every distinct chunk once (digest, payload), ``recipes`` lists for each
document, in ascending doc_id order over its part files, the digests and lengths of its chunks with the Merkle root
over them, and ``manifest`` has one row per recipe shard: counts, ids before it, and the Merkle root over its documents.

Ids are cut where a rolling hash of the last WINDOW ids meets a mask, so equal passages make equal chunks wherever they
stand. A payload is the ids as little-endian unsigned 16-bit integers, or 32-bit ones where an id needs them (its first
byte says which). The bytes are shuffled once, by digest, after each task has dropped what it has seen itself. Reading
back recomputes each chunk's digest and CRC-32 where it lies; CRCs of chunks are combined to those of documents by
shifting them over the bytes that follow, which is linear, so a document's rows need never meet in one place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.llm.bpe import PATTERN, _byte_letters
from brindle.llm.textvec import U, mix
from brindle.session import ship_package

WINDOW, LEAST, MOST, MASK = 8, 64, 1024, U(255)
DIGEST = 16
#: Words, and parts of words, that a worker remembers in each of two generations; parts that go to the library at once.
MEMO, AT_ONCE = 250_000, 500
_GEAR = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; no leaves have the hash of nothing."""
    if not leaves:
        return digest(b"")
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def marks(ids: np.ndarray) -> list[int]:
    """The places behind which the rolling hash meets the mask. Those of ids that lie behind one another are those of
    each alone from its WINDOW-th place on, and no chunk ends before its LEAST-th."""
    n = len(ids)
    h = mix(ids.astype(np.uint64) + U(1))
    roll = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):
        roll[k:] += h[: n - k] * _GEAR[k]
    return (np.flatnonzero((roll >> U(40)) & MASK == 0) + 1).tolist()


def ends(found: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the ids from begin to end, by the marks found in the whole array."""
    out, at = [], begin
    while end - at > LEAST:
        k = bisect_left(found, at + LEAST)
        at = min(found[k] if k < len(found) else end, at + MOST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id array: LEAST to MOST ids each (the last may be shorter), by content."""
    return ends(marks(ids), 0, len(ids))


def pack(raw: bytes, ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) and ids.max() < 65536 else b"\4" + raw


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[:1] == b"\2" else "<u4", offset=1).astype("<u4")


# ---- CRC-32 of joined byte strings -------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """For each power of two of bytes, the 32 columns of the linear map that appending so many zero bytes makes."""
    one = np.array([zlib.crc32(b"\0", 1 << k) ^ zlib.crc32(b"\0", 0) for k in range(32)], np.uint32)
    tables = [one]
    for _ in range(47):
        last = tables[-1]
        tables.append(_apply(last, last))
    return np.array(tables)


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint32)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & np.uint32(1), columns[k], np.uint32(0))
    return out


def crc_shift(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC adds to that of the whole, with so many bytes after it; the whole's CRC is the XOR of all."""
    out, after = crcs.astype(np.uint32), after.astype(np.int64)
    for bit, table in enumerate(_shift_tables()):
        rows = np.flatnonzero((after >> bit) & 1)
        if len(rows):
            out[rows] = _apply(table, out[rows])
        if not (after >> (bit + 1)).any():
            break
    return out


# ---- tokenizing ----------------------------------------------------------------------------------------------------


class _Letters(dict):
    """The byte-level letters of each character."""

    def __init__(self):
        super().__init__()
        self.of_byte = _byte_letters()

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self.of_byte[b] for b in chr(code).encode())
        return out


class _Memory:
    """What the library made of strings: two generations of MEMO each, the older of which gives way."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, keys: set[str]) -> list[str]:
        """Those of keys that are in neither generation; the others are in the young one afterwards."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old, fresh = self.young, self.old, []
        for w in keys.difference(young):
            if (known := old.get(w)) is not None:
                young[w] = known
            else:
                fresh.append(w)
        return fresh


class WordTokenizer:
    """The tokenizers library behind a memory of words and of their parts.

    Texts are parted at spaces and line feeds, at which the vocabulary's pre-tokenizer parts them too, and each distinct
    word is looked up once a batch. Plain words are parted as the pre-tokenizer would (its normalization only lower-cases
    them), so that words which differ in case or marks share their parts. Parts go to the library's model many at a time,
    joined by spaces, and are told from each other by their end-of-word tokens; all other words go whole to the
    vocabulary's own tokenizer."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["end_of_word_suffix"] != "</w>" or split["pattern"]["Regex"] != PATTERN:
            raise ValueError("this is another kind of vocabulary")
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        #: The same model for parts in byte-level letters, without the steps before it.
        self.model = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix="</w>"))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.letters = _Letters()
        # letters that neither normalization nor lower-casing takes apart, and no white space
        self.plain = "[\x21-\x7E¡-įı-ɏ]+"
        # PATTERN for plain words in lower case, which makes do with these characters, and the spaces between words
        low = sorted({chr(c).lower() for c in (*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250))})
        letter, number = ("".join(x for x in low if regex.fullmatch(kind, x)) for kind in (r"\p{L}", r"\p{N}"))
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^ {letter}{number}]+| ")
        self.words, self.pieces = _Memory(), _Memory()

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), AT_ONCE):
            some = parts[k : k + AT_ONCE]
            text = " ".join([p if p.isascii() else p.translate(self.letters) for p in some])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(at) != len(some) + 1 or at[-1] != 4 * len(ids):
                raise ValueError("the vocabulary does not end each part with an end-of-word token")
            raw = ids.tobytes()
            self.pieces.young.update(zip(some, [raw[a:b] for a, b in zip(at[:-1], at[1:])]))

    def _plain(self, words: list[str]) -> list[bytes]:
        """The ids of plain words, by their parts; a space between two has none."""
        found = self.parts.findall(" ".join(words).lower())
        self._learn(self.pieces.unknown(set(found) - {" "}))
        known = self.pieces.young
        known[" "] = b""
        ids = list(map(known.__getitem__, found))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        upto = np.cumsum(size)
        raw = b"".join(ids)
        at = [0, *upto[size == 0].tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end), without end ids; a null text has none."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = self.words.unknown(set(words))
        if fresh:
            given = pa.array(fresh, texts.type)
            plain = pc.and_(pc.match_substring_regex(given, rf"\A{self.plain}\z"), pc.invert(pc.match_substring(given, "<|"))).to_pylist()
            for some, how in (([w for w, p in zip(fresh, plain) if p], self._plain), ([w for w, p in zip(fresh, plain) if not p], self._whole)):
                if some:
                    self.words.young.update(zip(some, how(some)))
        ids = list(map(self.words.young.__getitem__, words))
        pool, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = coded.indices.to_numpy()
        count = size[place]
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = pool[np.repeat((np.cumsum(size) - size)[place] - upto[:-1], count) + np.arange(upto[-1])]
        at = split.offsets.to_numpy()
        return flat, upto[at - at[0]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        flat, at = self.encode_flat(pa.array(texts, pa.string()))
        raw, at = flat.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=2)
def tokenizer(file: str) -> WordTokenizer:
    return WordTokenizer(file)


# ---- writing -------------------------------------------------------------------------------------------------------


def _groups(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (column 1) have about ``most`` bytes together; a longer text is a part by itself or ends one."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at[:-1], at[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def write_store(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 2, group: int = 4 << 20) -> None:
    """Encode docs (doc_id, text, ...), append end_id to each document, and write the store to path, which must be new.

    Null text counts as empty (the end id alone). Rows with a null doc_id are left out; rows that repeat a doc_id are
    documents of their own, ordered by their chunks' digests. An empty table makes an empty store. Other columns are
    ignored. group: bytes of text that are encoded together."""
    spark = docs.sparkSession
    ship_package(spark)
    kinds = "kind int, doc_id long, digest binary, lengths binary, payload binary"
    names = [x.split(" ")[0] for x in kinds.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.idstore import ends, marks, tokenizer

        t, seen = tokenizer(vocabulary), set()
        for whole in batches:
            for batch in _groups(whole, group):
                rows: list[tuple] = []
                flat, at = t.encode_flat(batch.column(1))
                ids = np.insert(flat, at[1:], end_id).astype("<u4", copy=False)
                raw, found = ids.tobytes(), marks(ids)
                bounds = (at + np.arange(len(at))).tolist()
                for doc, begin, last in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                    leaves, lengths, at = [], [], begin
                    for to in ends(found, begin, last):
                        part = raw[4 * at : 4 * to]
                        d = digest(part)
                        if d not in seen:
                            seen.add(d)
                            rows.append((1, None, d, None, pack(part, ids[at:to])))
                        leaves.append(d), lengths.append(to - at)
                        at = to
                    rows.append((0, doc, b"".join(leaves), np.array(lengths, "<u4").tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types)], names=names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            kind, keys = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for k in np.flatnonzero(kind == 1):
                if keys[k] in seen:
                    keep[k] = False
                else:
                    seen.add(keys[k])
            yield batch if keep.all() else batch.filter(pa.array(keep))

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # recipes of copies are alike: they are dealt by doc_id, chunks by digest
    dealt = texts.mapInArrow(chop, kinds).repartition(F.when(F.col("kind") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("digest")))
    dealt.mapInArrow(once, kinds).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/store")

    recipe = "shard int, doc_id long, in_shard long, n_tokens long, root binary, digests binary, lengths binary"

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n, starts, roots = [], [], []
            for leaves, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n.append(int(np.frombuffer(lengths, "<u4").sum(dtype=np.int64)))
                roots.append(merkle([leaves[k : k + DIGEST] for k in range(0, len(leaves), DIGEST)]))
                starts.append(at)
                at += n[-1]
            cols = [pa.array([shard] * batch.num_rows, pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(roots, pa.binary()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in recipe.split(", ")])

    plain = _stored(spark, path, 0).select("doc_id", F.col("digest").alias("digests"), "lengths")
    plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digests").mapInArrow(order, recipe).write.option("compression", "zstd").parquet(f"{path}/recipes")

    def root(pdf):
        import pandas as pd

        pdf = pdf.sort_values("in_shard")
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "docs": [len(pdf)], "ids": [int(pdf["n_tokens"].sum())], "root": [merkle(pdf["root"].tolist())]})

    recipes = spark.read.schema(recipe).parquet(f"{path}/recipes")
    manifest = recipes.select("shard", "in_shard", "n_tokens", "root").groupBy("shard").applyInPandas(root, "shard int, docs long, ids long, root binary")
    # one row for each shard, so no more rows than there were shuffle partitions
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest.withColumn("before", before).coalesce(1).write.parquet(f"{path}/manifest")


def _stored(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema("doc_id long, digest binary, lengths binary, payload binary, kind int").parquet(f"{path}/store").where(F.col("kind") == kind).drop("kind")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.schema("shard int, doc_id long, in_shard long, n_tokens long, root binary, digests binary, lengths binary").parquet(f"{path}/recipes")
    manifest = spark.read.schema("shard int, docs long, ids long, root binary, before long").parquet(f"{path}/manifest").select("shard", "before")
    return recipes.join(F.broadcast(manifest), "shard").withColumn("start", F.col("before") + F.col("in_shard"))


def _leaves(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of each document: start, doc_id, seq, digest, ids, ids after it. Checks the Merkle root."""
    schema = "start long, doc_id long, seq int, digest binary, n long, after long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for start, doc, root, digests, lengths in zip(*(batch.column(k).to_pylist() for k in range(5))):
                leaves = [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]
                if merkle(leaves) != root:
                    raise ValueError(f"the recipe of document {doc} does not match its root")
                n = np.frombuffer(lengths, "<u4").astype(np.int64)
                after = n.sum() - np.cumsum(n)
                for col, values in zip(out, ([start] * len(n), [doc] * len(n), range(len(n)), leaves, n.tolist(), after.tolist())):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=[x.split(" ")[0] for x in schema.split(", ")])

    return recipes.select("start", "doc_id", "root", "digests", "lengths").mapInArrow(run, schema)


def _checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, stored_n and crc of every chunk, from its bytes; a chunk that is not what its digest says raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, crcs = batch.column(0).to_pylist(), [], []
            for key, payload in zip(keys, batch.column(1).to_pylist()):
                raw = unpack(payload).tobytes()
                if digest(raw) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                sizes.append(len(raw) // 4), crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "stored_n", "crc"])

    return _stored(spark, path, 1).select("digest", "payload").mapInArrow(run, "digest binary, stored_n long, crc long")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the chunks' bytes as they are read back.

    Raises if a chunk, a recipe or a length is not what it should be, or a chunk is missing."""
    leaves = _leaves(_recipes(spark, path))
    joined = leaves.hint("merge").join(_checked_chunks(spark, path).hint("merge"), "digest", "left")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, stored = batch.column(2), batch.column(4)
            if stored.null_count or not n.equals(stored):
                raise ValueError("a recipe asks for a chunk that the store does not hold")
            part = crc_shift(batch.column(5).to_numpy().astype(np.uint32), 4 * batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(part.astype(np.int64))], names=["start", "doc_id", "n", "part"])

    parts = joined.select("start", "doc_id", "n", "after", "stored_n", "crc").mapInArrow(shift, "start long, doc_id long, n long, part long")
    return parts.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids array<long>) of the documents, or of those named, rebuilt from their chunks."""
    recipes = _recipes(spark, path)
    if doc_ids is not None:
        recipes = recipes.where(F.col("doc_id").isin(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [unpack(p).tolist() for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["digest", "part"])

    chunks = _stored(spark, path, 1).select("digest", "payload").mapInArrow(run, "digest binary, part array<long>")
    joined = _leaves(recipes).hint("merge").join(chunks.hint("merge"), "digest")
    ordered = joined.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("x"))
    return ordered.select("doc_id", "start", F.flatten("x.part").alias("ids"))
