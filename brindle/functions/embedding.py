"""Embedders: callables from texts to a float32 matrix, applied in Arrow batches; the default needs no model file."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

from brindle.session import ship_package

Embedder = Callable[[list[str]], np.ndarray]
_CACHE: dict[tuple, Embedder] = {}


#: Words that are counted together.
STEP = 2048


@lru_cache(maxsize=16)
def _crc_tables(n: int) -> list[np.ndarray]:
    """For each place of n bytes a table by their value; the entries of n bytes, combined by exclusive or, are their CRC-32."""
    zero = zlib.crc32(bytes(n))
    return [np.array([zlib.crc32(bytes(i) + bytes([b]) + bytes(n - 1 - i)) ^ (0 if i == 0 else zero) for b in range(256)], np.int64) for i in range(n)]


def hashing_embedder(dim: int = 256, grams: tuple[int, ...] = (3, 4)) -> Embedder:
    """Signed feature hashing of all words and their character n-grams (Weinberger et al., 2009), scaled to length 1.

    There is no window: texts of any length count whole, STEP words at a time."""

    def run(texts: list[str]) -> np.ndarray:
        sums = np.zeros((len(texts), dim), np.int64)
        for k, t in enumerate(texts):
            words = (m[0] for m in re.finditer(r"\S+", t.lower()))
            while step := Counter(islice(words, STEP)):
                times = np.fromiter(step.values(), np.int64, len(step))
                hashes, weights = [np.fromiter(map(zlib.crc32, map(str.encode, step)), np.int64, len(step))], [times]
                plain = np.fromiter(map(str.isascii, step), bool, len(step))
                # grams of ASCII words all at once, within one string of padded words
                joined = np.frombuffer("".join(f" {w} " for w in step if w.isascii()).encode(), np.uint8)
                sizes = np.fromiter((len(w) + 2 for w in step if w.isascii()), np.int64, int(plain.sum()))
                each, left = np.repeat(times[plain], sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(joined))
                for n in grams:
                    at = np.flatnonzero(left >= n)
                    tables = _crc_tables(n)
                    hashes.append(reduce(np.bitwise_xor, (tables[i][joined[at + i]] for i in range(n))))
                    weights.append(each[at])
                for w, often in step.items():
                    if not w.isascii():
                        own = [p[i : i + n] for p in (f" {w} ",) for n in grams for i in range(len(p) - n + 1)]
                        hashes.append(np.fromiter(map(zlib.crc32, map(str.encode, own)), np.int64, len(own)))
                        weights.append(np.full(len(own), often))
                h = np.concatenate(hashes)
                signed = np.where((h >> 31) & 1, 1, -1) * np.concatenate(weights)
                # whole numbers far below 2 ** 53, so doubles hold them
                sums[k] += np.bincount(h % dim, signed, dim).astype(np.int64)
        out = sums.astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return run


def token_embedder(file: str, dim: int = 256, max_tokens: int = 2048, seed: int = 5) -> Embedder:
    """The mean of fixed random vectors of a text's first max_tokens tokens, scaled to length 1: an embedder with a window, as
    trained models have one. file: a tokenizer that the tokenizers library reads, which must exist on every executor."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.enable_truncation(max_tokens)
    vectors = np.random.default_rng(seed).standard_normal((tokenizer.get_vocab_size(), dim)).astype(np.float32)

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids, times = np.unique(np.array(e.ids, np.int64), return_counts=True)
            if len(ids):
                out[k] = times.astype(np.float32) @ vectors[ids]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return run


def cached(key: tuple, make: Callable[[], Embedder]) -> Embedder:
    """One embedder for each key in a process."""
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def embed_query(embedder: Embedder, query: str, dim: int, prefix: str = "") -> list[float]:
    if not query or not query.strip():
        raise ValueError("the query is empty")
    vector = np.asarray(embedder([prefix + query]), np.float32)
    if vector.shape != (1, dim):
        raise ValueError(f"the embedder gave {vector.shape}, not (1, {dim})")
    return vector[0].tolist()


def embed_passages(df: DataFrame, make: Callable[[], Embedder], key: tuple, dim: int, *, text: str = "text", prefix: str = "", batch: int = 64) -> DataFrame:
    """df with a column vector, computed in micro-batches by one embedder per worker; the prefix isn't stored."""
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema, T.StructField("vector", T.ArrayType(T.FloatType(), False), False)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = cached(key, make)
        for pdf in frames:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch].copy()
                vectors = np.asarray(embedder([prefix + t for t in part[text]]), np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"the embedder gave {vectors.shape}, not ({len(part)}, {dim})")
                part["vector"] = list(vectors)
                yield part

    return df.mapInPandas(run, schema)
