"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first turned
by two places and the second by one; a text's profile is the sum over all its trigrams, words being parted by one space
that counts as a letter. A language's prototype is the sum of its texts' profiles. A text gets the language whose
prototype has the largest cosine to its profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from brindle.llm.sampling import id_hash
from brindle.session import ship_package

DIM = 1024
UND = "und"
#: Texts are taken together up to so many characters; a longer one is a group of its own.
GROUP = 1 << 19
#: Kinds of trigrams whose vectors are held at once.
KINDS = 1 << 14
#: Heads of training texts that stand for short texts, and how floors follow from their cosines.
HEADS = (4, 8, 16, 32, 64, 128, 256)
FLOOR_TAIL, FLOOR_SHARE, LONG = 0.001, 0.75, 8
#: Cosines are counted in steps of 1 / STEPS for the floors.
STEPS = 10_000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1 << 15)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng(code + 17).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


def profiles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, profile) of each text; None without letters."""
    return ((k, p) for k, p, _ in counted_profiles(texts))


def counted_profiles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None, int]]:
    """(row, profile, number of trigrams) of each text; None and 0 without letters."""
    table, a = letter_table(), 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= GROUP):
            size += len(texts[b] or "")
            b += 1
        # a space before and behind each text, so that the trigrams of two texts never mix
        lengths = np.array([len(t or "") + 2 for t in texts[a:b]])
        joined = "".join(f" {t or ''} " for t in texts[a:b])
        codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(b - a), lengths)
        keep = np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])))
        codes, owner = codes[keep], owner[keep]
        alphabet, dense = np.unique(codes, return_inverse=True)
        n = len(alphabet)
        tri = (dense[:-2].astype(np.int64) * n + dense[1:-1]) * n + dense[2:]
        tri[(owner[2:] != owner[:-2])] = -1
        at = np.searchsorted(owner[: len(tri)], np.arange(b - a + 1))
        counted = []
        for k in range(b - a):
            u, c = np.unique(tri[at[k] : at[k + 1]], return_counts=True)
            if len(u) and u[0] == -1:
                u, c = u[1:], c[1:]
            counted.append((u, c))
        kinds = np.unique(np.concatenate([u for u, _ in counted])) if counted else np.zeros(0, np.int64)
        shared = bound_vectors(kinds, alphabet) if len(kinds) <= KINDS else None
        for k, (u, c) in enumerate(counted):
            if not len(u):
                yield a + k, None, 0
            elif shared is not None:
                yield a + k, c.astype(np.float32) @ shared[np.searchsorted(kinds, u)].astype(np.float32), int(c.sum())
            else:
                total = np.zeros(DIM, np.float32)
                for at in range(0, len(u), KINDS):
                    total += c[at : at + KINDS].astype(np.float32) @ bound_vectors(u[at : at + KINDS], alphabet).astype(np.float32)
                yield a + k, total, int(c.sum())
        a = b


def bound_vectors(kinds: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, numbers to the base of the alphabet's size: their letters' vectors turned and multiplied."""
    n = len(alphabet)
    digits = np.stack((kinds // (n * n), kinds // n % n, kinds % n))
    used, place = np.unique(digits, return_inverse=True)
    place = place.reshape(digits.shape)
    letters = np.stack([letter_vector(int(c)) for c in alphabet[used]]) if len(used) else np.zeros((0, DIM), np.int8)
    out = np.roll(letters, 2, axis=1)[place[0]]
    out *= np.roll(letters, 1, axis=1)[place[1]]
    out *= letters[place[2]]
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes, scaled to length 1, from all docs (doc_id, text, lang, ...).

    Null texts, texts without a letter and rows without a lang teach nothing; repeated rows teach as often as they stand.
    No labelled rows give no prototypes. Other columns are ignored."""
    ship_package(docs.sparkSession)
    chosen = docs.where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for k, p in profiles(batch.column(1).to_pylist()):
                if p is not None:
                    sums[langs[k]] = sums.get(langs[k], np.zeros(DIM)) + p
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM)), pa.array(v.astype(np.int64))], names=["lang", "place", "value"])

    rows = chosen.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, place long, value long")
    found: dict[str, np.ndarray] = {}
    for lang, place, value in rows.groupBy("lang", "place").agg(F.sum("value")).collect():  # DIM rows for each language
        found.setdefault(lang, np.zeros(DIM))[place] = value
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def size_class(trigrams: int) -> int:
    """0 for one trigram, 1 for two or three, 2 for four to seven, and so on to LONG, from where length matters little."""
    return min(max(trigrams, 1).bit_length() - 1, LONG)


def learn_floors(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> dict[int, float]:
    """For each size class of texts, the least cosine at which a text counts as one of a learned language.

    Learned on all rows with a lang, on whole texts and, as short texts are rare, on their heads of HEADS code points, cut
    behind a word: FLOOR_SHARE of the cosine that all but FLOOR_TAIL of a class reach, to a STEPSth. A class without texts
    has no floor."""
    ship_package(docs.sparkSession)
    chosen = docs.where("lang is not null and text is not null")
    if not prototypes:
        return {}
    matrix = np.stack(list(prototypes.values())).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((LONG + 1, 2 * STEPS + 1), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                heads = [h[0] for n in HEADS if n < len(t) and (h := t[: n + 1].rsplit(None, 1)) and h[0]]
                for _, p, n in counted_profiles([t, *heads]):
                    if p is not None and (length := np.linalg.norm(p.astype(np.float64))) > 0:
                        counts[size_class(n), min(max(int(np.floor((matrix @ p).max() / length * STEPS)), -STEPS), STEPS) + STEPS] += 1
        size, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(step), pa.array(counts[size, step])], names=["size", "step", "n"])

    rows = chosen.select(F.col("text").cast("string")).mapInArrow(run, "size long, step long, n long")
    found = np.zeros((LONG + 1, 2 * STEPS + 1), np.int64)
    for size, step, n in rows.groupBy("size", "step").agg(F.sum("n")).collect():  # 2 * STEPS + 1 rows for each class at most
        found[size, step] = n
    total = found.sum(axis=1)
    # the step that the row at this place of a class, in ascending order, lies in
    at = [int(np.searchsorted(np.cumsum(own), int(FLOOR_TAIL * (n - 1)) + 1)) - STEPS for own, n in zip(found, total)]
    return {k: FLOOR_SHARE * at[k] / STEPS for k in range(LONG + 1) if total[k]}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], floors: dict[int, float] | None = None) -> DataFrame:
    """docs with lang_pred and score added, each taking the place of a column of that name.

    score is the cosine, negative ones as 0. Null texts, texts without a letter, and all texts where nothing was learned
    get und and 0. A tie goes to the language that sorts first. With floors, a text whose cosine is under the floor of its
    size class gets und and keeps its score. One row for each input row, whatever its doc_id; repeated rows get the same
    answer, texts of any length are read whole, and an empty table gives an empty result."""
    ship_package(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float64) if names else np.zeros((0, DIM))
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double")
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            for k, p, n in counted_profiles(batch.column(where).to_pylist()):
                if p is not None and names and (length := np.linalg.norm(p.astype(np.float64))) > 0:
                    cosines = matrix @ p / length
                    best = int(np.argmax(cosines))
                    known = cosines[best] >= (floors.get(size_class(n), -1.0) if floors else -1.0)
                    langs[k], scores[k] = names[best] if known else UND, min(1.0, max(0.0, float(cosines[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that the contract lets learn: CRC-32 of doc_id modulo 4 is not 2."""
    return docs.where(F.pmod(id_hash("doc_id"), F.lit(4)) != 2)
