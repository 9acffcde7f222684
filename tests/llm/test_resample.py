"""Importance resampling against a plain loop over every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from brindle.llm import resample
from brindle.llm.textvec import PUNCT

WORDS = "alpha beta gamma delta Epsilon zeta 42 éta ÉTA 你好 naïve iota".split()
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(docs, items, percent=5):
    per = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in per for b in f), Counter(b for _, text in items for b in plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for i, n, f in per:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    long = sorted((-score, i) for i, _, _, score, n in rows if n >= 20 and i is not None)
    rank = {}
    for k, x in enumerate(long[: percent * len(long) // 100]):
        rank.setdefault((-x[0], x[1]), []).append(k + 1)
    out = []
    for i, f, weight, score, n in rows:
        left = rank.get((score, i)) if n >= 20 else None
        out.append((i, f, weight, score, left.pop(0) if left else None))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_features long, rank string")


def prose(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", "  ", ", ", "-", "\n"]) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t!"), (903, "x"), (904, "A b"), (905, "é́ 你好 \U0001f600 a\x00b\x7fc"), (906, "word " * 30_000), (907, "y" * 3000 + " z" * 25), (None, "null id " * 20)]


def test_resampling_equals_a_plain_loop(spark):
    r = random.Random(1)
    copy = prose(r, 60)
    docs = [(k, prose(r, r.choice((3, 19, 20, 21, 200)))) for k in range(150)] + ODD + [(k, copy) for k in range(300, 340)] + [(400, copy)] * 3
    items = [(k, prose(r, 30)) for k in range(6)] + [(7, None), (8, copy)]
    for percent in (5, 50):
        got = resample.resample(frame(spark, docs), frame(spark, items), percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == plain(docs, items, percent)


def test_empty_tables(spark):
    r = random.Random(2)
    docs = [(k, prose(r, 40)) for k in range(60)]
    none = frame(spark, [])
    assert resample.resample(none, frame(spark, docs)).count() == 0 and resample.resample(none, none).count() == 0
    assert Counter(map(tuple, resample.resample(frame(spark, docs), none).collect())) == plain(docs, [])


def test_long_texts_are_worked_through_in_steps():
    r = random.Random(3)
    texts = [prose(r, 2000), "", "q" * 700 + " " + prose(r, 300), "", "only", prose(r, 900), "w" * 5000]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [plain_features(t) for t in texts]
    for step in (64, 1000, 1 << 20):
        stream, words = resample.feature_buckets(np.frombuffer(raw, np.uint8), offsets, step)
        assert words.tolist() == [n for n, _ in want]
        ends = np.cumsum(resample.features_of(words))
        assert [sorted(stream[e - len(f) : e].tolist()) for e, (_, f) in zip(ends, want)] == [sorted(f) for _, f in want]


def test_hashes_of_joined_words():
    r = random.Random(4)
    for size in (0, 1, 5, 64, 65, 255, 256, 257, 5000):
        a, b = bytes(r.choices(range(256), k=9)), bytes(r.choices(range(256), k=size))
        joined = resample.behind(np.array([zlib.crc32(a)], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(b))
        assert int(joined[0]) == zlib.crc32(a + b)
    assert PUNCT[0x2F] and not PUNCT[0x30] and PUNCT[0x60] and not PUNCT[0x61] and PUNCT[0x7F] and not PUNCT[0x80]


def test_whole_tables(spark):
    import os

    import duckdb
    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from brindle.llm.queries import op13_importance_resampling

    docs, items = (duckdb.sql(f"SELECT {c}, text FROM '{folder}/{t}.parquet'").fetchall() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert Counter(map(tuple, op13_importance_resampling(spark, folder).collect())) == plain(docs, items)
