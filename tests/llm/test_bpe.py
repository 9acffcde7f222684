"""The merge kernel, the transducer and the BPE codec against plain versions and the library."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from brindle.llm import bpe, merging, pieces
from brindle.llm.automaton import Lexicon, compile_words
from brindle.llm.queries import vocabulary

FILE = vocabulary("word_bpe_49k.json")


def plain_merge(sym, pairs):
    """One merge at a time: of all pairs the one of the least rank, the leftmost at a tie."""
    sym = list(sym)
    while True:
        found = [(pairs[a, b][0], k) for k, (a, b) in enumerate(zip(sym, sym[1:])) if (a, b) in pairs]
        if not found:
            return sym
        _, k = min(found)
        sym[k : k + 2] = [pairs[sym[k], sym[k + 1]][1]]


def test_merge_rounds_equal_single_merges():
    r = random.Random(4)
    for seed in range(60):
        pairs, n = {}, 4
        for rank in range(40):
            a, b = r.randrange(n), r.randrange(n)
            if (a, b) not in pairs:
                pairs[a, b] = (rank, n)
                n += 1
        if seed % 3 == 0:  # ranks that fall behind those of what they are made of
            ranks = r.sample(range(len(pairs)), len(pairs))
            pairs = {k: (x, m) for x, (k, (_, m)) in zip(ranks, pairs.items())}
        first = Counter()
        for (a, b), (rank, _) in pairs.items():
            for x in (a, b):
                first[x] = min(first.get(x, 1 << 30), rank)
        careful = {k for k, (rank, m) in enumerate(pairs.values()) if first.get(m, 1 << 30) <= rank}
        t = merging.PairTable([a for a, _ in pairs], [b for _, b in pairs], [m for _, m in pairs.values()], [x for x, _ in pairs.values()], careful)
        words = [[r.randrange(4) for _ in range(r.choice((1, 2, 5, 33, 64, 200)))] for _ in range(12)] + [[0] * 97]
        sym, owner = merging.merge_words(np.array(sum(words, [])), np.repeat(np.arange(len(words)), [len(w) for w in words]), t)
        for k, w in enumerate(words):
            assert sym[owner == k].tolist() == plain_merge(w, pairs)
    assert merging.merge_words(np.zeros(0, int), np.zeros(0, int), t)[0].size == 0


def test_long_words_take_rounds_that_cost_their_merges():
    r = random.Random(5)
    word = "".join(r.choice("abcdeéöß的一是不了人我在") for _ in range(80_000))
    for c, library in ((pieces.PieceCodec(vocabulary("piece_bpe_32k.model")), None), (bpe.BpeCodec(FILE), True)):
        began = time.process_time()
        got = c.encode([word])[0]
        assert time.process_time() - began < 6  # about 1 s on a machine of its own
        if library is None:
            assert got.tolist() == c.library.encode(word) + [2]
        else:
            from tokenizers import Tokenizer

            assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(FILE).encode(word, add_special_tokens=False).ids


def test_transducer_knows_its_words_and_no_others(tmp_path):
    r = random.Random(6)
    for n in (0, 1, 3, 2000):
        words = {bytes(r.choice(b"abc\xff\x00") for _ in range(r.randint(0, 7))) for _ in range(n)}
        known = {w: tuple(r.randrange(5) for _ in range(r.randint(0, 4))) for w in words}
        raw = compile_words(sorted(known.items()))
        raw.tofile(tmp_path / "lexicon.bin")
        mapped = Lexicon(str(tmp_path / "lexicon.bin"))
        asked = [*known, *(w + b"q" for w in known), *(w[:-1] for w in known), b"", b"zz"]
        want = [np.array(known[w], "<u4").tobytes() if w in known else None for w in asked]
        assert mapped.find(asked) == Lexicon(raw).find(asked) == want
    # endings are shared: thousands of words with the same endings need few states
    stems = [f"{a}{b}".encode() for a in "bcdfghjklm" for b in "bcdfghjklm"]
    raw = compile_words(sorted((s + e, (k, 7)) for k, s in enumerate(stems) for e in (b"ing", b"ed", b"er", b"s")))
    assert Lexicon(raw).states < 20
    with pytest.raises(ValueError):
        compile_words([(b"b", ()), (b"a", ())])


def odd_texts():
    r = random.Random(7)
    points = [*range(1, 0x2FFF), *range(0xA000, 0xABFF), *range(0xF900, 0xFFFE), *range(0x10000, 0x10FFF), *range(0x1F000, 0x1FFFF)]
    fixed = [
        "", " ", "\n\n", "\x00a\x1cb\x1dc d\x85e", "éé ΑΣ Σ İstanbul ǅ ﬁ ½²³ 你好 😀", "<|endoftext|>a<|startoftext|><|endoftext|", "it's I'LL we'RE 'S x'd", "a b　c d", "ſt ẞ ŉ K Å",
        "¡a­b﻿", "١٢٣ ⅷ Ⅷ", "‘quoted’ — “text”… 5€", "x" * 5000, "word " * 30_000,
    ]
    return fixed + ["".join(map(chr, r.choices(points, k=200))) for _ in range(60)] + ["".join(r.choice("ab'Σσ <|endoftext|>sméÉÍ\n\t\r—") for _ in range(60)) + "<|endoftext|>" for _ in range(100)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    rows = [(None, None), (None, "null id"), (7, "twice"), (7, "twice"), *((k + 100, t) for k, t in enumerate(odd_texts()))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, word long")
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        want[(i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode()))] += 1
    for lexicon in (None, bpe.build_lexicon(docs, FILE), bpe.build_lexicon(docs, FILE, most=0)):
        assert Counter(tuple(x) for x in bpe.encode_decode(docs, FILE, lexicon=lexicon).collect()) == want
    got = bpe.encode_decode(docs, FILE, keep_ids=True).where("doc_id = 104").first()
    assert library.encode(rows[8][1], add_special_tokens=False).ids == got.ids and hashlib.sha256(got.decoded.encode()).hexdigest() == got.decoded_sha256
    none = docs.where("false")
    assert bpe.encode_decode(none, FILE, lexicon=bpe.build_lexicon(none, FILE)).count() == 0


def test_the_lexicon_holds_the_frequent_words_of_all_documents(spark, monkeypatch):
    texts = ["common " * 50 + f"rare{chr(97 + k)}" + " middle" * 4 for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(bpe, "HELD", 3)
    counts = {bytes(x.word).decode(): x.n for x in bpe.word_counts(docs, FILE).collect()}
    assert counts == Counter(w for t in texts for w in t.split())
    assert {bytes(x.word).decode() for x in bpe.frequent_words(docs, FILE, 5).collect()} == {"common", "middle"}
    assert bpe.frequent_words(docs, FILE, 1000).count() == 22


def test_long_texts_are_cut_at_spaces_only(monkeypatch):
    c = bpe.BpeCodec(FILE)
    text = "one two\nthree " * 50 + "unbroken" * 30
    parts = [t for group in bpe._steps([text, None, "x"], step=40) for row, t in group if row == 0]
    assert len(parts) > 3 and " ".join(parts) == text and b"".join(c.encode(parts)) == c.encode([text])[0]
