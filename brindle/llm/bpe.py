"""BPE encoding and decoding with a compiled lexicon of the corpus's frequent words; unseen words are merged exactly.

Words, as the vocabulary's pre-tokenizer parts normalized text, are counted over all documents; the most frequent are
encoded once, compiled into a transducer (brindle.llm.automaton) whose outputs are their ids, and sent to the executors
as one file that their workers map into memory together. A text's words are looked up in it, and those it does not hold
go through the merge rounds of brindle.llm.merging. Which words it holds changes no id.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from brindle.llm.automaton import Lexicon, compile_words
from brindle.llm.merging import PairTable, merge_words
from brindle.session import discard, materialize, scratch, ship_package

#: Words that the lexicon holds at most, and their bytes.
LEXICON, LONGEST = 1 << 17, 64
#: Distinct words that a task counts before it gives them out, and characters of text that are encoded together.
HELD, GROUP = 200_000, 4 << 20
END = "</w>"
# how this kind of vocabulary parts normalized text (fixed pattern of its file; any other is refused)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that normalization leaves alone but for their case, each lower-cased by itself, and common white space.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E¡-įı-ɏ\u2010-\u2027\u2030-\u205E€]*")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or one of those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in out))
    return [out[b] for b in range(256)]


class BpeCodec:
    """Encodes as the tokenizers library does with a byte-level BPE vocabulary with word ends, and decodes as it does."""

    def __init__(self, file: str, lexicon: Lexicon | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["end_of_word_suffix"] != END or split["pattern"]["Regex"] != PATTERN or spec["decoder"] is not None:
            raise ValueError("this is another kind of vocabulary")
        # for words of letters that need real normalization: the library's own rules of it, not its encoder
        self.normalizer, self.parts_of = library.normalizer, library.pre_tokenizer
        self.parts = regex.compile(PATTERN)
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        every = vocab | self.special
        self.token_of = [""] * (max(every.values()) + 1)
        for s, i in every.items():
            self.token_of[i] = s
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        # symbols are ids: of a byte inside a word, and of one at its end
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + END] for c in letters], np.int64)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a]), right.append(vocab[b]), made.append(vocab[a + b])
        # a merge after which a better one may begin with, or end in, what it made is made one at a time
        first = {}
        for k, (a, b) in enumerate(zip(left, right)):
            first.setdefault(a, k), first.setdefault(b, k)
        careful = {k for k, m in enumerate(made) if first.get(m, len(made)) <= k}
        self.table = PairTable(left, right, made, list(range(len(made))), careful)
        self.lexicon = lexicon or Lexicon(compile_words([]))

    # ---- words -----------------------------------------------------------------------------------------------------

    def words_of(self, text: str) -> list[str | int]:
        """The words of a text, normalized; a special token that is written out is its id."""
        if "<|" in text and self.specials is not None and len(parts := self.specials.split(text)) > 1:
            return [w for p in parts if p for w in ([self.special[p]] if p in self.special else self.words_of(p))]
        if PLAIN.fullmatch(text):
            return self.parts.findall(text.lower())
        return [w for run in text.replace("\n", " ").split(" ") if run for w in self._run(run)]

    def _run(self, run: str) -> list[str]:
        """The words of what stands between spaces or line feeds, at which words end in any case."""
        if PLAIN.fullmatch(run):
            return self.parts.findall(run.lower())
        norm = self.normalizer.normalize_str(run)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.parts_of.pre_tokenize_str(norm)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty) by merge rounds alone, as little-endian 32-bit integers."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        ids, owner = merge_words(sym, np.repeat(np.arange(len(words)), size), self.table)
        at = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        spelled = ids.astype("<u4").tobytes()
        return [spelled[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        found = self.lexicon.find(words)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.merge([words[k] for k in unseen])):
            found[k] = ids
        return found

    # ---- texts -----------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Each distinct word is looked up once."""
        split = [self.words_of(t) for t in texts]
        words = [w for w in set().union(*split) if type(w) is str]
        ids: dict = dict(zip(words, self.encode_words([w.encode() for w in words])))
        ids.update((i, np.array([i], "<u4").tobytes()) for i in self.special.values())
        return [b"".join(map(ids.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as the library decodes where a vocabulary names no decoder."""
        return " ".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _steps(texts: list[str | None], step: int = GROUP) -> Iterator[list[tuple[int, str]]]:
    """(row, text) in groups of about step characters; a longer text is cut at spaces, its parts being rows alike in number."""
    group: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        text = text or ""
        while len(text) > step and (cut := text.find(" ", step)) > 0:
            yield group + [(row, text[:cut])]
            group, held, text = [], 0, text[cut + 1 :]
        group.append((row, text))
        held += len(text)
        if held > step:
            yield group
            group, held = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def codec(file: str, lexicon: str | None = None) -> BpeCodec:
    """lexicon: the name of a file that the session sent to the executors."""
    return BpeCodec(file, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def word_counts(docs: DataFrame, file: str) -> DataFrame:
    """(word, n): how often each word of at most LONGEST bytes occurs in the texts of docs (text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.bpe import codec

        c, held = codec(file), Counter()

        def given() -> pa.RecordBatch:
            found = [(raw, n) for w, n in held.items() if type(w) is str and len(raw := w.encode()) <= LONGEST]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in _steps([text]):
                    for _, t in part:
                        held.update(c.words_of(t))
                    if len(held) > HELD:
                        yield given()
        if held:
            yield given()

    ship_package(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, file: str, most: int = LEXICON) -> DataFrame:
    """The words (word) at or above the lowest count, by steps of a sixteenth of its logarithm, that at most ``most`` words reach."""
    counts = materialize(word_counts(docs, file), "word-counts")
    level = F.floor(16 * F.log2("n"))
    # some thousand levels at most
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, lowest = 0, None
    for at, n in levels:
        if (total := total + n) > most:
            break
        lowest = at
    return counts.where(level >= lowest if lowest is not None else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, file: str, most: int = LEXICON) -> str:
    """Compile the frequent words of docs and send them to the executors: the file's name for codec().

    At most ``most`` words of LONGEST bytes meet on the driver; the file lies in the shared folder, from which executors
    that come later fetch it too."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.bpe import codec

        c = codec(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.merge(batch.column(0).to_pylist()), pa.binary())], names=["word", "ids"])

    ready = materialize(frequent_words(docs, file, most).mapInArrow(run, "word binary, ids binary"), "lexicon")
    entries = sorted((bytes(r[0]), tuple(np.frombuffer(bytes(r[1]), "<u4").tolist())) for r in ready.toLocalIterator())
    raw = compile_words(entries).tobytes()
    path = scratch(spark, "lexicon") + ".bin"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()
    spark.sparkContext.addFile(path)
    discard(ready)
    return path.rsplit("/", 1)[1]


def encode_decode(docs: DataFrame, file: str, *, lexicon: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with keep_ids) for docs (doc_id, text, ...).

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers. One row for each input row, rows that repeat a
    doc_id or have a null one included, in any order; no rows give none. Null text counts as empty, which has no id and
    decodes to nothing. Texts of any length are encoded whole, cut at spaces into parts of bounded size. Special tokens
    written out in a text are those tokens, as in the library. lexicon: the name that build_lexicon() gives; without one
    all words are merged, with the same ids. file must exist on every executor. Other columns are ignored."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.bpe import codec

        c = codec(file, lexicon)
        for batch in batches:
            ids: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for group in _steps(batch.column(1).to_pylist()):
                for (row, _), raw in zip(group, c.encode([t for _, t in group])):
                    ids[row].append(raw)
            whole = [x[0] if len(x) == 1 else b"".join(x) for x in ids]
            decoded = (c.decode(x) for x in whole)
            cols = [batch.column(0), pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in whole])]
            if keep_ids:
                texts = list(decoded)
                cols += [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array([np.frombuffer(x, "<u4").tolist() for x in whole], pa.list_(pa.int64())), pa.array(texts)]
            else:
                cols.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
