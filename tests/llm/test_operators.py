"""Each operator on small fixtures: null, empty and long texts, ties and repeats, empty tables, extra columns, and brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, components, decontaminate, html_blocks, html_main, idstore, language, licences, near_dup, pieces, skew, toxicity, vector_dup
from brindle.llm.queries import vocabulary

DOCS = "doc_id long, text string, score string, rep long, n long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "!!! ???"), (904, "x"), (905, "é́ 你好 \U0001f600 a\x00b"), (906, "word " * 30_000)]


def brute_components(ids, linked):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {x.id: x.component_id for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()


def test_components_with_hubs_are_dealt_and_equal(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 1 / 20)
    edges = [(500, k) for k in range(400, 480)] + [(k, 500) for k in range(501, 560)] + [(700, 401), (700, 3), (900, 901), (None, 4), (5, 5)]
    got = {x.id: x.component_id for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 3 for k in [3, 700, *range(400, 480), *range(500, 560)]} | {900: 900, 901: 900}
    assert components._shape(spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "u long, v long")) == (3, 0, 2)
    assert components._shape(spark.createDataFrame([(9, 1), (9, 2), (10, 9)], "u long, v long")) == (3, 1, 3)
    low = spark.createDataFrame([(500, 400, 139), (700, 3, 2)], "u long, m long, n long")
    assert [r.u for r in skew.hot_keys(low, ["u"], 200, "n").collect()] == [500]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(7)
    rows = list(ODD)
    for g in range(14):
        base = prose(r, r.randint(4, 90)).split()
        for c in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 3))
            rows.append((g * 100 + c + 5000, " ".join(w)))
    rows += [(3000, "ALPHA Beta"), (3001, "alpha beta"), (3002, "alpha")]
    for size, percent in ((3, 85), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dup.near_duplicates(docs(spark, rows), shingle=size, percent=percent).collect()}
        sets = {i: shingle_set(t, size) for i, t in rows}
        linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = brute_components(sets, linked)
        assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_in_crowded_buckets_equal_brute_force(spark, monkeypatch):
    """Most texts share a common passage and so buckets, but few of them link: they meet by rare shingles."""
    monkeypatch.setattr(near_dup, "DEALT", 3)
    r = random.Random(17)
    passage, rows = prose(r, 60), []
    for k in range(90):
        own = [f"own{r.randint(0, 10**6)}" for _ in range(r.choice([8, 14, 25]))]
        for c in range(r.choice([1, 1, 1, 4])):
            w = list(own)
            if c:
                w[r.randrange(len(w))] = "edit"
            rows.append((len(rows), passage + " " + " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs(spark, rows), shingle=3, percent=85).collect()}
    sets = {i: shingle_set(t, 3) for i, t in rows}
    assert got == brute_components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])


def test_rare_groups_of_a_bucket_of_single_members_stay_small(spark):
    r = random.Random(18)
    passage, n = prose(r, 60), 20_000
    rows = [(k, passage + " " + " ".join(f"own{k}x{j}" for j in range(40))) for k in range(n)]
    d = docs(spark, rows + [(n, rows[0][1] + " more")])
    members = d.select(F.lit(1).cast("long").alias("bucket"), "doc_id", F.col("doc_id").alias("component_id"), F.lit(n + 1).cast("long").alias("n"))
    groups = near_dup.rare_groups(members, d.select("doc_id", "text"), shingle=3, percent=85)
    dealt = near_dup.deal(near_dup.with_largest(groups)).groupBy("bucket").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).collect()
    assert {tuple(x.ids) for x in dealt} == {(0, n)}


def test_near_duplicates_of_repeats_and_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    got = near_dup.near_duplicates(docs(spark, [(1, "b c"), (1, "a b"), (2, "a b"), (None, "a b")])).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1)]
    r = np.random.default_rng(1)
    sets = [np.unique(np.concatenate((np.arange(40), 100 + r.integers(0, 30, 8)))).astype(np.uint64) for _ in range(30)]
    ids, label = near_dup.linked_parts(np.arange(30), sets, 80)
    pairs = [(a, b) for a, b in itertools.combinations(range(30), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    want = brute_components(range(30), pairs)
    assert dict(zip(ids.tolist(), label.tolist())) == {k: v for k, v in want.items() if v < k}


def test_densified_signatures_agree_like_the_sets():
    bins, r = 240, np.random.default_rng(2)
    orders, same = near_dup.bin_orders(240), []
    for n in (1, 5, 400):
        both = r.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, r.integers(0, 1 << 63, max(1, n // 4), dtype=np.uint64)))) for _ in range(2))
        same.append((np.mean(near_dup.one_permutation(a, bins, orders) == near_dup.one_permutation(b, bins, orders)), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert all(0 <= s <= 1 for s, _ in same) and abs(same[2][0] - same[2][1]) < 0.12


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(40):
        c = r.standard_normal(16)
        for _ in range(int(r.choice([1, 3, 8]))):
            rows.append((len(rows), (c + 0.25 * r.standard_normal(16)).astype(np.float32).tolist()))
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, [2 * v for v in rows[0][1]]), (n + 2, None), (n + 3, [0.0] * 16), (n + 4, [float("nan")] * 16), (n + 5, [float("inf")] * 16), (n + 6, []), (n + 7, [1.0, 2.0]), (n + 8, [1.0, 2.0])]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vector_dup.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, weight int")).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want = brute_components([i for i, _ in rows], linked)
    assert got == {i: (sum(i in p for p in linked), want[i], want[i] == i) for i, _ in rows}
    assert vector_dup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_doubles_in_crowded_buckets(spark, monkeypatch):
    for name, value in (("BLOCK", 20), ("BUCKET", 30), ("STRIP", 7)):
        monkeypatch.setattr(vector_dup, name, value)
    r = np.random.default_rng(9)
    x = np.concatenate([c + 0.2 * r.standard_normal((n, 12)) for n in (150, 30, 5, 1) for c in [r.standard_normal(12)]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(500, x[0].tolist())] * 3, "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in vector_dup.near_vectors(df).collect()}
    ids = [*range(len(x)), 500]
    u = np.concatenate((x, x[:1]))
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    assert got == {i: (int(near[k].sum()), want[i]) for k, i in enumerate(ids)}


def test_blocks_count_pairs_once():
    r = np.random.default_rng(6)
    x = r.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    signs = r.integers(0, 2, (60, 3)).astype(np.int32)
    total = np.zeros(60, np.int64)
    for t in range(3):
        for s in (0, 1):
            m = np.flatnonzero(signs[:, t] == s)
            side = m % 2 == 1
            for which, sd in ((m[side], None), (m[~side], None), (m, side)):
                at, links, _ = vector_dup.block_links(which, np.ones(len(which), np.int64), x[which], signs[which], t, sd, 0.5)
                np.add.at(total, which[at], links)
    met = (signs[:, None, :] == signs[None, :, :]).any(axis=2)
    near = (x @ x.T >= 0.5) & met & ~np.eye(60, dtype=bool)
    assert (total == near.sum(axis=1)).all()


def test_tables_tell_fewer_cosines_than_all_pairs():
    for n in (5_000, 20_000, 100_000, 10**6, 10**9):
        bits, tables = vector_dup.plan(n, 0.9)
        alike = (1 - math.acos(0.9) / math.pi) ** bits
        assert tables / 2**bits < (1 if n < 50_000 else 0.2) and (1 - alike) ** tables <= 1e-4


def test_sentencepiece_equals_the_library(spark):
    c = pieces.PieceCodec(vocabulary("piece_bpe_32k.model"))
    r = random.Random(1)
    texts = [None, "", " ", "  a", "a" * 3000, " " * 200, "<s></s>", *(t for _, t in ODD)] + ["".join(r.choices(list("aabcdeinst  ▁\n\té1́😀你好ﬁ"), k=r.randint(1, 60))) for _ in range(1500)]
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == c.library.encode(t or "") + [2] and c.decode(ids) == c.library.decode(ids.tolist())
    got = pieces.encode_decode(docs(spark, ODD), vocabulary("piece_bpe_32k.model"), keep_ids=True).collect()
    assert len(got) == len(ODD) and all(hashlib.sha256(x.decoded.encode()).hexdigest() == x.decoded_sha256 for x in got)
    assert pieces.encode_decode(docs(spark, []), vocabulary("piece_bpe_32k.model")).count() == 0


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(2)
    copy = prose(r, 3000)
    rows = [*ODD, (1, copy), (2, copy), (3, "new start " + copy), (4, "it's <|endoftext|> İstanbul ŉ ß K"), (5, prose(r, 5)), (None, "left out")]
    path = str(tmp_path / "store")
    idstore.write_store(docs(spark, rows), path, vocabulary("word_bpe_49k.json"))
    library, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    got = {x.doc_id: x for x in idstore.verify_store(spark, path).collect()}
    back = {x.doc_id: x.ids for x in idstore.read_documents(spark, path).collect()}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and back[i] == ids
        start += len(ids)
    stored = spark.read.parquet(f"{path}/store").where("kind = 1")
    assert stored.count() == stored.select("digest").distinct().count()
    sizes = stored.select(F.sum(F.length("payload") - 1)).first()[0]
    assert sizes < 2 * 0.7 * start  # copies are stored once
    empty = str(tmp_path / "empty")
    idstore.write_store(docs(spark, []), empty, vocabulary("word_bpe_49k.json"))
    assert idstore.verify_store(spark, empty).count() == 0


def test_words_share_their_parts():
    from tokenizers import Tokenizer

    file = vocabulary("word_bpe_49k.json")
    library, t = Tokenizer.from_file(file), idstore.WordTokenizer(file)
    letters = [chr(c) for c in (*range(1, 0x250), 0x2C65, 0x2C66, 0x3C3, 0x1E9E, 0x4E2D, 0x1F600)]
    odd = [f"{x} {x}{x} a{x}b {x}'LL 1{x}2 É{x}Ⱥ{x}" for x in letters]
    texts = [*odd, " ".join(odd), "", None, " ", "\n\n a\n", "a\tb\r\nc\x00d", "<|endoftext|>x a<|b|>", "it'S we'Re 'S ''s x'm'd²", "x" * 3000]
    for got, text in zip(t.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text

    given, model = [], t.model

    class Spy:
        def encode_batch_fast(self, texts, **more):
            given.extend(w for x in texts for w in x.split(" "))
            return model.encode_batch_fast(texts, **more)

    t.model = Spy()
    t.encode(["Sharedword sharedword, (sharedword) SHAREDWORD! sharedword's", "sharedword; 'sharedword' [sharedword]"])
    t.encode(["-sharedword- sharedword?"])
    assert given.count("sharedword") == 1  # forms of a word go to the library once


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "s")
    idstore.write_store(docs(spark, [(1, prose(random.Random(1), 900))]), path, vocabulary("word_bpe_49k.json"))
    bad = spark.read.parquet(f"{path}/store").where("kind = 1").withColumn("payload", F.expr("overlay(payload placing x'ff' from 3)"))
    bad.drop("kind").write.parquet(str(tmp_path / "bad"))
    import shutil

    shutil.rmtree(f"{path}/store/kind=1")
    shutil.move(str(tmp_path / "bad"), f"{path}/store/kind=1")
    with pytest.raises(Exception, match="damaged"):
        idstore.verify_store(spark, path).collect()


def test_crc_and_merkle():
    r = random.Random(5)
    parts = [r.randbytes(4 * r.randint(1, 900)) for _ in range(40)]
    after = np.array([sum(map(len, parts[k + 1 :])) for k in range(40)])
    assert np.bitwise_xor.reduce(idstore.crc_shift(np.array([zlib.crc32(p) for p in parts], np.uint32), after)) == zlib.crc32(b"".join(parts))
    assert idstore.merkle([b"a", b"b", b"c"]) != idstore.merkle([b"a", b"c", b"b"]) and idstore.cuts(np.zeros(0, np.uint32)) == []
    ids = np.random.default_rng(0).integers(0, 49408, 50_000)
    ends = idstore.cuts(ids)
    assert ends[-1] == 50_000 and max(np.diff([0, *ends])) <= idstore.MOST
    assert len({e + 7 for e in ends} & set(idstore.cuts(np.concatenate((np.arange(7), ids))))) > 0.9 * len(ends)


def test_language(spark):
    r = random.Random(1)
    speak = {"en": "the of and to in that is was for with", "de": "der die und in den von zu das mit sich", "fr": "le la les et des en un du une que"}
    rows = [(k, " ".join(r.choices(speak[g].split(), k=r.randint(8, 40))), g) for k in range(300) for g in [r.choice(list(speak))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language.learn(language.training_rows(df))
    held = language.identify(df, p).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).collect()
    assert len(held) > 40 and np.mean([x.lang == x.lang_pred for x in held]) > 0.97 and all(0 <= x.score <= 1 for x in held)
    odd = {x.doc_id: x for x in language.identify(docs(spark, ODD), p).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (900, 901, 902, 903)) and odd[904].lang_pred in p and odd[906].rep == 1
    assert language.learn(df.limit(0)) == {} and language.identify(docs(spark, ODD), {}).where("lang_pred <> 'und'").count() == 0
    a, b = (dict(language.profiles([t]))[0] for t in ("ab cd", "ab  cd!"))
    assert (a == b).all()


def test_language_stage_rejects_texts_of_no_language(spark):
    import corpus_pipeline

    r = random.Random(5)
    speak = {"en": "the of and to in that is was for with", "de": "der die und in den von zu das mit sich", "fr": "le la les et des en un du une que"}
    rows = [(k, " ".join(r.choices(speak[g].split(), k=r.randint(8, 90))), g) for k in range(300) for g in [r.choice(list(speak))]]
    junk = ["".join(r.choices(a, k=n)) for n in (150, 400) for a in ("αβγδεζηθικλμνξοπρστυ ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "жщюяфъыэ ", "0123456789abcdef")] + ["!? 123", None]
    clean = ["the", "and to", "der", "die und das", "le la les", "that is for the", "mit sich"]
    rows += [(1000 + k, t, None) for k, t in enumerate(junk)] + [(2000 + k, t, None) for k, t in enumerate(clean)]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_unidentified(spark, df, "").select("doc_id").collect()}
    assert {k for k in kept if k >= 1000} == {2000 + k for k in range(len(clean))} and len([k for k in kept if k < 1000]) >= 298
    assert language.learn_floors(df.limit(0), {}) == {}


def test_toxicity(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        w = prose(r, r.randint(5, 200)).split()
        toxic = k % 4 == 0
        for _ in range(1 + len(w) // 25 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["moron", "scum", "loser"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    d, ls = docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    net = toxicity.learn(d, toxicity.training_labels(ls))
    got = {x.doc_id: x for x in toxicity.score_texts(d, net).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in held]) > 0.9 and all(0 <= got[k].score <= 1 for k in got)
    late = toxicity.score_texts(docs(spark, [(1, rows[1][1] + " " + "plain1 " * 5000 + "moron scum loser moron"), *ODD]), net)
    by = {x.doc_id: x for x in late.collect()}
    assert by[1].predicted == 1 and by[900].score == by[901].score == by[903].score == 0 and by[900].rep == 1
    assert toxicity.fit([], []) and toxicity.learn(d, ls.limit(0)) and toxicity.windows(0) == [] and toxicity.windows(33) == [(0, 32), (16, 33)]


def test_gradient_is_the_slope():
    net = toxicity.Network(np.arange(5, dtype=np.uint64))
    rng = np.random.default_rng(0)
    word, tri, first = np.array([0, 1, 2]), rng.integers(0, 50, 6), np.array([0, 2, 4])
    index, mask = rng.integers(0, 3, (4, toxicity.WIDTH)), (np.arange(toxicity.WIDTH)[None] < np.array([32, 5, 9, 1])[:, None]).astype(np.float32)
    y = np.array([1, 0, 1, 0], np.float32)
    _, g = net.gradient(word, tri, first, index, mask, y)
    for name, at in (("uf", (1, 2)), ("wb", (3, 20)), ("wa", (2, 2)), ("word", (1, 3)), ("bo", (0,))):
        keep, e = net.p[name][at], 0.02
        loss = []
        for step in (e, -e):
            net.p[name][at] = keep + step
            loss.append(net.gradient(word, tri, first, index, mask, y)[0])
        net.p[name][at] = keep
        assert abs((loss[0] - loss[1]) / (2 * e) - g[name][at]) < 2e-3


def test_decontamination(spark):
    r = random.Random(3)
    items = [prose(r, 30), prose(r, 20), "one two three four five", None, ""]
    swapped = items[0].split()
    for k in (4, 11, 18, 25):
        swapped[k] = "changed"
    rows = [(1, prose(r, 40) + " " + items[0] + " " + prose(r, 40)), (2, prose(r, 10) + ". " + " ".join(swapped).upper()), (3, "so One, two three; four five!"), (4, "one two three four six"), (5, prose(r, 200)), (6, " ".join(items[1].split()[:8])), (1, "again"), (None, items[0]), *ODD]
    b = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(0, items[0], 1)], "item_id long, text string, seed int")
    got = {(x.doc_id, x.item_id): (x.n_tokens, x.n_same) for x in decontaminate.contaminated(docs(spark, rows), b).collect()}
    assert got == {(1, 0): (30, 30), (2, 0): (got[(2, 0)][0], got[(2, 0)][1]), (3, 2): (5, 5)} and got[(2, 0)][0] >= 12 and got[(2, 0)][1] >= 0.8 * got[(2, 0)][0]
    kept = {x.doc_id for x in decontaminate.clean_documents(docs(spark, rows), b).collect()}
    assert kept == {None, 4, 5, 6, *(i for i, _ in ODD)}
    assert decontaminate.contaminated(docs(spark, []), b).count() == 0 and decontaminate.contaminated(docs(spark, rows), b.limit(0)).count() == 0


def brute_stretches(rows, items):
    """The best stretch of each pair by trying all of a diagonal's pairs of hits; items of at least SPAN tokens."""
    span, out = decontaminate.SPAN, {}
    for d, a in rows:
        for k, b in items:
            for shift in range(-len(b) + span, len(a) - span + 1):
                eq = {p: a[p + shift] == b[p] for p in range(len(b)) if 0 <= p + shift < len(a)}
                hits = [p for p in eq if p + span - 1 in eq and any(all(eq[p + o] for o in m) for m in decontaminate.MASKS)]
                for lo in hits:
                    for hi in (p + span for p in hits if p >= lo):
                        n = sum(eq[p] for p in range(lo, hi))
                        if n * 5 >= (hi - lo) * 4:
                            out[d, k] = max(out.get((d, k), (0,)), (n, -lo, -shift, hi))
    return {k: (-lo - shift, -lo, hi + lo, n) for k, (n, lo, shift, hi) in out.items()}


def test_decontamination_of_parted_copies(spark):
    r = random.Random(11)
    items = [[f"w{r.randint(0, 10**6)}" for _ in range(n)] for n in (59, 38, 30, 120)]
    rows = []
    for n, cuts in ((0, (20, 39)), (1, (15, 23)), (0, (23, 36)), (2, (12, 18))):
        t = list(items[n])
        t[cuts[0] : cuts[1]] = ["other"] * (cuts[1] - cuts[0])
        rows.append((len(rows), ["so"] * r.randint(0, 9) + t + ["end"]))
    rows.append((len(rows), items[3][:20] + ["so"] * 80 + items[3][-20:]))
    rows.append((len(rows), items[3][:20]))
    for _ in range(40):
        t = list(r.choice(items))
        p = r.choice((0.05, 0.15, 0.25, 0.35))
        rows.append((len(rows), ["x"] * r.randint(0, 5) + [f"y{j}" if r.random() < p else w for j, w in enumerate(t)] + t[: r.randint(0, 20)]))
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, [(d, " ".join(t)) for d, t in rows]), b).collect()
    want = brute_stretches(rows, list(enumerate(items)))
    assert {(x.doc_id, x.item_id): (x.doc_start, x.item_start, x.n_tokens, x.n_same) for x in got} == want
    assert {(0, 0), (1, 1), (2, 0), (3, 2), (4, 3), (5, 3)} <= set(want)


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo\n"), (1, 3, None, None), (1, 2, "bob", "yo\n"), (1, None, "ann", "first"), (2, 0, "system", "only")]
    rows += [(None, 0, "ann", "x"), (3, 640, "a", "late"), (3, -7, "a", "early")]
    df = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, piece int")
    got = {(x.conv_id, x.participant, x.piece): x for x in chat.perspectives(df).collect()}
    assert sorted(got, key=str) == sorted([(1, p, 0) for p in ("ann", "bob", "unknown")] + [(3, "a", 0)], key=str)
    x = got[(1, "bob", 0)]
    assert x.text == "<|user:ann|>\nfirst<|end|>\n<|system|>\nS<|end|>\n<|user:ann|>\nhi<|end|>\n" + "<|assistant|>\nyo\n<|end|>\n" * 2 + "<|user:unknown|>\n<|end|>\n"
    assert [x.text[s.start : s.end] for s in x.spans] == ["yo\n<|end|>\n"] * 2 and x.n_turns == 6
    assert got[(3, "a", 0)].text == "<|assistant|>\nearly<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert chat.perspectives(df.limit(0)).count() == 0


def test_crowded_chat_equals_its_sql_and_plain_python(spark, tmp_path):
    import duckdb

    from brindle.llm.queries import op1_perspective_rotation

    r = random.Random(8)
    rows = [(1, 3, r.choice(["ann", "bob", None]), f"t{r.randint(0, 900)}") for _ in range(3000)] + [(1, None, "ann", "same")] * 1500 + [(1, k, "bob", None) for k in range(-40, 10)]
    rows += [(1, 70, "bob", "late"), (2, 0, "system", "s"), (2, 1, "ann", "x")] + [(9, k * 1000, "ann", "sparse") for k in range(600)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    cols = ["conv_id", "participant", "piece", "n_turns", "text", "mask_spans"]
    got = sorted(tuple(x[c] for c in cols) for x in op1_perspective_rotation(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({chat.ORACLE})").fetchall())
    ordered = sorted(((t is not None, t or 0, p or "unknown", x or "") for c, t, p, x in rows if c == 1))
    for person in ("ann", "bob", "unknown"):
        whole = "".join(("<|assistant|>\n" if p == person else f"<|user:{p}|>\n") + x + "<|end|>\n" for _, _, p, x in ordered)
        assert "".join(g[4] for g in got if g[:2] == (1, person)) == whole
    assert [g[2] for g in got if g[:2] == (9, "ann")] == [0, 1, 2] and [g[3] for g in got if g[:2] == (9, "ann")] == [256, 256, 88]


def naive_licence(text, least=licences.LEAST):
    """The nearest template by the cosines of all stretches and the words that only one of two has, with words and dictionaries."""
    split = lambda t: re.findall(r"[a-z0-9]+", t.translate({c: c + 32 for c in range(65, 91)}))
    bodies = {t for _, t in licences.BODIES}
    templates = [(n, split(t), t in bodies) for n, t in (*licences.TEMPLATES, *licences.BODIES)]
    held = {}
    for _, t, _ in templates:
        for w in set(t):
            held[w] = held.get(w, 0) + 1
    idf = lambda w: math.log((1 + len(templates)) / (1 + held.get(w, 0))) + 1

    def vector(ws):
        v = {w: ws.count(w) * idf(w) for w in set(ws)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    terms, found = split(text), []
    for name, t, body in sorted(templates, key=lambda x: -len(x[1])):
        target, best = vector(t), (0.0, 0)
        for a in range(max(1, len(terms) - len(t) + 1)) if terms else ():
            score = sum(x * target.get(w, 0.0) for w, x in vector(terms[a : a + len(t)]).items())
            best = (score, a) if score > best[0] + 1e-9 else best
        if best[0] >= least:
            found.append((best[0], name, t, best[1], body))
    if not found:
        return None, 0.0
    found = sorted([f for f in found if f[4]] or found, key=lambda f: -round(f[0], 12))
    now = top = found[0]
    for f in found[1:]:
        (_, name, t, at, _), (_, name2, t2, at2, _) = now, f
        a, b = min(at, at2), max(at + len(t), at2 + len(t2))
        if f[0] < top[0] - licences.NEAR or name == name2 or b - a >= len(t) + len(t2):
            continue
        seen, shares = terms[a:b], []
        both = {w: min(t.count(w), t2.count(w)) for w in (*t, *t2)}
        for x in (t, t2):
            own = {w: x.count(w) - both[w] for w in set(x) if x.count(w) > both[w]}
            total = sum(n * idf(w) for w, n in own.items())
            shares.append(sum(min(n, max(0, seen.count(w) - both[w])) * idf(w) for w, n in own.items()) / total if own else None)
        mine, other = shares
        mine, other = (1 - other if mine is None else mine), (1 - mine if other is None else other)
        now = f if other > mine else now
    return now[1], now[0]


def own_licence(m, text):
    found = list(m.scan(pa.array([text], pa.large_string())))
    return (found[0][1], found[0][2]) if found else (None, 0.0)


def test_licences_equal_all_stretches():
    m, r = licences.Matcher(), random.Random(4)
    bodies = {n: t for n, t in licences.TEMPLATES}
    texts = ["the work is under version 2 of the plan", "Released under the Frobnitz License", "so Licensed under CC BY-NC 4.0. " * 3, "GNU General Public License", ""]
    for n, t in r.sample(licences.TEMPLATES, 6):
        w = t.split()
        for k in r.sample(range(len(w)), len(w) // 8):
            w[k] = r.choice(WORDS)
        texts += [prose(r, 9) + " " + " ".join(w) + " " + prose(r, 9), " ".join(w[: len(w) * 2 // 3])]
    for t in texts:
        want, got = naive_licence(t), own_licence(m, t)
        assert want[0] == got[0] and abs(want[1] - got[1]) < 1e-9, t
    assert m.vectors.max() < licences.LEAST and own_licence(m, "mit " * 40) == (None, 0.0)
    for n, t in licences.TEMPLATES:
        assert own_licence(m, "/* " + t.replace("\n", "\n * ") + " */") == (n, pytest.approx(1.0))
    assert own_licence(m, "Copyright 2020 A. Author\n" + bodies["BSD-2-Clause"])[0] == "BSD-2-Clause" and own_licence(m, bodies["BSD-3-Clause"])[0] == "BSD-3-Clause"
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert own_licence(m, lgpl.format("2.1"))[0] == "LGPL-2.1-or-later" and own_licence(m, lgpl.format("3"))[0] == "LGPL-3.0-or-later"
    assert own_licence(m, "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.")[0] == "GPL-2.0-only"


def altered(r, text, share):
    w = text.split()
    for k in r.sample(range(len(w)), max(1, round(share * len(w)))):
        w[k] = r.choice(WORDS)
    return " ".join(w)


def test_altered_headers_keep_their_licence():
    m, r = licences.Matcher(), random.Random(8)
    long = {}
    for n, t in licences.TEMPLATES:
        if "GPL" in n and len(t.split()) > 60:
            long[n] = t
    kept = none = 0
    for n, t in long.items():
        for _ in range(20):
            got = own_licence(m, prose(r, 6) + " " + altered(r, t, 0.03) + " " + prose(r, 6))[0]
            kept += got == n
        none += sum(own_licence(m, altered(r, t, 0.03))[0] is None for _ in range(20))
    assert len(long) == 10 and kept >= 0.98 * 200 and none == 0, kept


def test_bodies_name_licence_files(spark):
    m, r = licences.Matcher(), random.Random(9)
    header = dict(licences.TEMPLATES)["GPL-3.0-or-later"]
    for n, t in licences.BODIES:
        file = t + " " + prose(r, 3000) + " How to apply these terms. " + header + " " + prose(r, 50)
        ((_, name, score, whole),) = list(m.scan(pa.array([file], pa.large_string())))
        assert name == n and score == pytest.approx(1.0) and whole == pytest.approx(1.0)
    body = dict(licences.BODIES)["Apache-2.0"]
    files, want, folders = [], {}, ["", "/a", "/a/b", "/a/b/c", "/a/d", "/e", "/e/f/g"]
    for k in range(120):
        folder = r.choice(folders)
        files.append((f"{folder}/x{k}.py", "code " * r.randint(0, 5)))
    files += [("/LICENSE", "Released under the MIT License"), ("/a/b/LICENSE.txt", body + " and so on" * 2000), ("/e/f/COPYING", altered(r, dict(licences.BODIES)["GPL-2.0-only"], 0.03) + " more" * 900), ("/a/notes.txt", body)]
    given = {"": "MIT", "/a/b": "Apache-2.0", "/e/f": "GPL-2.0-only"}
    for path, text in files:
        at = path.rsplit("/", 1)[0]
        while at not in given:
            at = at.rsplit("/", 1)[0]
        want[path] = ("own", "Apache-2.0") if path == "/a/notes.txt" else (("own" if path.rsplit("/", 1)[1][0].isupper() else "inherited"), given[at])
    got = licences.scan(spark.createDataFrame(files, "path string, text string")).collect()
    assert {x.path: (x.origin, x.licence) for x in got} == want and len(got) == len(files)


def test_altered_bodies_in_long_texts_take_no_longer_than_others():
    m, r = licences.Matcher(), random.Random(10)
    mit = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len)
    text = " ".join(altered(r, mit, 0.1) for _ in range(1000))
    began = time.process_time()
    name, _ = own_licence(m, text)
    assert name == "MIT" and len(text) > 900_000 and time.process_time() - began < 6  # about 1 s on a machine of its own


def test_licences(spark):
    rows = [("/a/LICENSE", "Released under the MIT License."), ("/a/b/c/x.py", "code"), ("/a/b/COPYING", "Licensed under CC BY-NC 4.0"), ("/a/y.py", None), ("/z/x.py", ""), ("/z/own.py", "# Licensed under the Apache License, Version 2.0 (the"), (None, "x"), ("/a/y.py", None),
            ("/z/t.py", "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\ncode"), ("/z/long.py", "word " * 200_000 + "Released under the MIT License" + " word" * 200_000)]
    got = sorted((x.path or "", x.licence or "", x.origin, x.source_path or "") for x in licences.scan(spark.createDataFrame([(*x, "k") for x in rows], "path string, text string, licence string")).collect())
    assert got == [("", "", "none", ""), ("/a/LICENSE", "MIT", "own", "/a/LICENSE"), ("/a/b/COPYING", "CC-BY-NC-4.0", "own", "/a/b/COPYING"), ("/a/b/c/x.py", "CC-BY-NC-4.0", "inherited", "/a/b/COPYING"),
                   ("/a/y.py", "MIT", "inherited", "/a/LICENSE"), ("/a/y.py", "MIT", "inherited", "/a/LICENSE"), ("/z/long.py", "MIT", "own", "/z/long.py"), ("/z/own.py", "Apache-2.0", "own", "/z/own.py"),
                   ("/z/t.py", "GPL-2.0-only WITH Classpath-exception-2.0", "own", "/z/t.py"), ("/z/x.py", "", "none", "")]
    assert licences.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_blocks_of_html():
    got = [b.text for b in html_blocks.blocks("<body><p><b>One&amp;two<br>x<p>A <i>b</i>\n c&nbsp;d<div>E<script>var t='</p>';</script></div><!-- no --><ul><li>f<li>g</ul>tail &lt;i&gt;")]
    assert got == ["One&two x", "A b c d", "E", "f", "g", "tail <i>"]
    assert html_blocks.blocks(None) == html_blocks.blocks("") == html_blocks.blocks("<p> </p><style>x") == [] and html_blocks.blocks("plain")[0].text == "plain"
    page = html_blocks.parse('<div id=k><p title="a>b" class="x">t')
    assert page.path(page.blocks[0]) == ("div", "#k", "p", ".x") and [b.text for b in html_blocks.blocks("a < b <")] == ["a < b <"]


def test_hidden_elements_of_html_end():
    shown = lambda page: [b.text for b in html_blocks.blocks(page)]
    for hidden in ("<svg class='i' viewBox='0 0 1 1'/>", "<math/>", "<svg><path d='M0'/><title>no</title><style/></svg>", "<svg><g><text>no</text></svg>", "<select><option>no<option>no</select>",
                   "<template><p>no</p></template>", "<video src=v><p>no</p></video>", "<object><object>no</object>no</object>", "<canvas>no</canvas>", "<svg><foreignObject><p>no</p></foreignObject></svg>"):
        assert shown(f"<p>one {hidden} two</p><p>three</p>")[-1] == "three" and " ".join(shown(f"<p>one {hidden} two</p>")) == "one two", hidden
    for tag in ("svg", "math", "object", "video", "audio", "canvas", "select", "datalist", "template"):
        assert shown(f"<body><div><{tag}>no</div><p>yes</p></body>") == ["yes"], tag
    assert shown("<div><svg><path><p>after svg</p>") == ["after svg"] and shown("a<script>no</p>") == ["a"] and shown("<iframe>no</iframe>b") == ["b"]


def test_main_text(spark):
    net, r = html_main.trained(), np.random.default_rng(123)
    right = total = 0
    for _ in range(60):
        page, y = html_main.unmarked(html_blocks.parse(html_main.make_page(r)))
        q = net.labels([page])[0]
        right, total = right + int((q == np.array(y)).sum()), total + len(y)
    assert right > 0.98 * total
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1><p>Some   prose &amp; more.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page)]
    got = html_main.main_text(spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in got) == [(0, "Head\nSome prose & more.", 23)] + [(1, "Head\nSome prose & more.", 23)] * 2 + [(2, "", 0), (3, "", 0)]


def plain_labels(net, page):
    """One page through the network, one block after the other, in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    H, s = html_main.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    xs = []
    for k, b in enumerate(page.blocks):
        names = page.path(b) or ("",)
        ws = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", b.text.encode()) if w]
        hashed = [int(html_main.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), html_main.PUNCT)[2][0]) % html_main.WORD_BUCKETS for w in ws]
        sizes = [math.log1p(len(b.text)) / 5, math.log1p(len(ws)) / 4, b.link_chars / max(1, len(b.text)), b.text[-1:] in ".!?:;…。", k / len(page.blocks), 1]
        word = p["word"][hashed].mean(axis=0) if ws else np.zeros(html_main.WORD_DIM)
        xs.append(np.concatenate((p["path"][[html_main.path_bucket(x) for x in names]].sum(axis=0), word, sizes)))
    states = np.zeros((len(xs), 2 * H))
    for d, order, part in (("f", range(len(xs)), slice(0, H)), ("b", range(len(xs) - 1, -1, -1), slice(H, 2 * H))):
        h, c = np.zeros(H), np.zeros(H)
        for t in order:
            g = xs[t] @ p[f"w{d}"] + h @ p[f"u{d}"] + p[f"b{d}"]
            c = s(g[:H]) * c + s(g[H : 2 * H]) * np.tanh(g[3 * H :])
            h = s(g[2 * H : 3 * H]) * np.tanh(c)
            states[t, part] = h
    return s(states @ p["wo"][: 2 * H] + np.array(xs) @ p["wo"][2 * H :] + p["bo"])


def test_main_text_equals_a_plain_network_and_bounds_long_pages():
    net, r = html_main.trained(), np.random.default_rng(321)
    for _ in range(25):
        page = html_main.unmarked(html_blocks.parse(html_main.make_page(r)))[0]
        want = plain_labels(net, page)
        sure = np.abs(want - 0.5) > 1e-3
        assert ((net.labels([page])[0] == (want >= 0.5)) | ~sure).all()
    # the gradient is the slope
    pages = [html_main.unmarked(html_blocks.parse(html_main.make_page(r))) for _ in range(3)]
    f, y = html_main.Features([p for p, _ in pages]), np.array([v for _, ys in pages for v in ys], np.float32)

    def loss():
        index, mask = f.index(np.arange(3))
        q = net.run(net.inputs(f), index, mask).astype(float)
        return float(-(mask * (y[index] * np.log(q + 1e-9) + (1 - y[index]) * np.log(1 - q + 1e-9))).sum() / mask.sum())

    own = html_main.Labeller()
    net = own
    g = net.gradient(f, np.arange(3), y, net.inputs(f))
    for name, at in (("uf", (1, 2)), ("wb", (3, 20)), ("wo", (4,)), ("path", (html_main.path_bucket("p"), 3))):
        keep, slope = net.p[name][at], []
        for step in (0.01, -0.01):
            net.p[name][at] = keep + step
            slope.append(loss())
        net.p[name][at] = keep
        assert abs((slope[0] - slope[1]) / 0.02 - g[name][at]) < 3e-3, name
    net = html_main.trained()
    began = time.time()
    flat = html_blocks.parse("<body><main>" + "<ul><li>item one two</ul>" * 20_000 + "</main>")
    deep = html_blocks.parse("<div class='a'>text</b>" * 20_000)
    assert len(flat.blocks) == len(deep.blocks) == 20_000 and len(deep.elements) == 20_000
    labels = net.labels([flat, deep, html_blocks.parse("<p>x")])
    assert [len(x) for x in labels] == [20_000, 20_000, 1] and time.time() - began < 40


def test_pipeline_against_its_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {x.doc_id: x.text for x in kept.select("doc_id", "text").collect()}
        kept = stage(spark, kept, sf).cache()
        after = {x.doc_id for x in kept.collect()}
        assert after <= set(before) and kept.columns == corpus_pipeline.COLUMNS and len(after) > 0.6 * len(before)
        if name == "minhash_near_dup":
            sets = {i: shingle_set(t, 5) for i, t in before.items()}
            want = brute_components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            assert after == {i for i in sets if want[i] == i}
    assert {x.doc_id for x in corpus_pipeline.run(spark, sf).collect()} == after


def test_dealt_blocks_meet_in_every_pair_across_components(spark, monkeypatch):
    """Bucket 1 has a large component and 11 others, bucket 2 fits one group, bucket 3 has only single members."""
    monkeypatch.setattr(near_dup, "DEALT", 4)
    rows = [(1, k, 0 if k < 30 else k, 41) for k in range(41)] + [(2, k, k // 2, 6) for k in range(6)] + [(3, k, k, 19) for k in range(100, 119)]
    groups: dict[tuple, list[int]] = {}
    for r in near_dup.deal(near_dup.with_largest(spark.createDataFrame(rows, "bucket long, doc_id long, component_id long, n long"))).collect():
        groups.setdefault((r.bucket, r.i, r.j), []).append(r.doc_id)
    met = {(key[0], a, b) for key, ids in groups.items() for a in ids for b in ids if a < b}
    assert all(len(ids) == len(set(ids)) for ids in groups.values())
    for b, d, c, _ in rows:
        for other, e, f, _ in rows:
            if b == other and d < e and c != f:
                assert (b, d, e) in met
    assert sum(map(len, groups.values())) < sum(n * -(-n // 4) for *_, n in rows)
