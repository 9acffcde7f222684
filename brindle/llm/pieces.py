"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes words: a run of the space mark with the characters up to the next mark. No piece of the model holds a
mark behind another character, so no merge crosses words. All distinct new words of a batch lie in one flat symbol
array, whatever their length, and are merged together by brindle.llm.merging.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from brindle.llm.merging import PairTable, merge_words
from brindle.session import ship_package

MARK = "▁"
#: Words that a worker remembers before it forgets them all, and the characters above which it remembers none.
MEMO, MEMO_LENGTH = 400_000, 256


class PieceCodec:
    """Encodes as the sentencepiece library does with a BPE model with identity normalisation, and decodes back."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.library = sp
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("pieces with a space mark behind another character need another way to part words")
        self.id_of = {self.pieces[i]: i for i in normal}
        self.unk, self.end = sp.unk_id(), sp.eos_id()
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.text_of = [b""] * n
        for i in normal:
            self.text_of[i] = self.pieces[i].replace(MARK, " ").encode()
        for b in range(256):
            if self.byte_ids[b] != self.unk:
                self.text_of[self.byte_ids[b]] = bytes([b])
        self.byte_range = frozenset(int(x) for x in self.byte_ids if x != self.unk)
        # symbols: ids of single characters; a character without a piece gets a number from n upwards, which no pair holds
        scores = {i: sp.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {i: order[scores[i]] for i in normal}
        tied = {}
        for i in normal:
            tied[rank[i]] = tied.get(rank[i], 0) + 1
        unsafe = {i for i in normal if tied[rank[i]] > 1}
        left, right, made = [], [], []
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
                    # a merge that makes way for a better one must be made one at a time
                    unsafe.update(x for x in (a, b) if rank[i] <= rank[x])
        self.table = PairTable(left, right, made, [rank[i] for i in made], {k for k, i in enumerate(made) if i in unsafe})
        self.memo: dict[str, np.ndarray] = {}

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, whose spaces are marks already."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds, sym = np.unique(codes, return_inverse=True)
        n = len(self.pieces)
        number = np.array([self.id_of.get(chr(c), n + k) for k, c in enumerate(kinds)], np.int64)
        ids, owner = merge_words(number[sym], np.repeat(np.arange(len(words)), lengths), self.table)
        if (ids >= n).any():
            ids, owner = self._as_bytes(ids, owner, kinds, n)
        at = np.searchsorted(owner, np.arange(len(words) + 1))
        ids = ids.astype(np.int32)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def _as_bytes(self, ids: np.ndarray, owner: np.ndarray, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        spelled = [self.byte_ids[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in kinds]
        size = np.array([len(x) for x in spelled])
        strange = np.flatnonzero(ids >= n)
        kind = ids[strange] - n
        count = np.ones(len(ids), np.int64)
        count[strange] = size[kind]
        out, at = np.repeat(ids, count), np.concatenate(([0], np.cumsum(count)[:-1]))
        flat, begin = np.concatenate(spelled), np.concatenate(([0], np.cumsum(size)[:-1]))
        step = np.arange(count[strange].sum()) - np.repeat(np.cumsum(size[kind]) - size[kind], size[kind])
        out[np.repeat(at[strange], size[kind]) + step] = flat[np.repeat(begin[kind], size[kind]) + step]
        return out, np.repeat(owner, count)

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text: marks and the characters behind them."""
        if not text:
            return []
        parts = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        if "" not in parts:
            return [MARK + p for p in parts]
        out, marks = [], 0
        for p in parts:
            marks += 1
            if p:
                out.append(MARK * marks + p)
                marks = 0
        return out + [MARK * marks] * bool(marks)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, with the end id; null counts as empty."""
        split = [self.split(t or "") for t in texts]
        memo = self.memo
        fresh = list({w for ws in split for w in ws if w not in memo})
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            fresh = list({w for ws in split for w in ws})
        found = dict(zip(fresh, self.encode_words(fresh)))
        memo.update((w, ids) for w, ids in found.items() if len(w) <= MEMO_LENGTH)
        end = np.array([self.end], np.int32)
        return [np.concatenate([*((memo[w] if w in memo else found[w]) for w in ws), end]) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control ids are silent, byte pieces are joined and read as UTF-8."""
        raw = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())
        return text.removeprefix(" ")


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_decode(docs: DataFrame, model_file: str, *, keep_ids: bool = False, group: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with keep_ids) for docs (doc_id, text, ...).

    One row for each input row, rows that repeat a doc_id or have a null one included, in any order; no rows give none. Null
    text is encoded as the empty one, which has the end id alone. Texts of any length are encoded whole, and their words in
    merge rounds of any length; a batch holds its texts' symbols in memory. model_file must exist on every executor.
    Other columns are ignored."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brindle.llm.pieces import codec

        c = codec(model_file)
        for whole in batches:
            for k in range(0, whole.num_rows, group):
                batch = whole.slice(k, group)
                encoded = c.encode(batch.column(1).to_pylist())
                decoded = [c.decode(x) for x in encoded]
                cols = [
                    batch.column(0), pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if keep_ids:
                    cols += [pa.array([x.tolist() for x in encoded], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
