"""Language and toxicity against the same definitions in plain loops."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import language, toxicity
from brindle.llm.textvec import PUNCT, mix, words

SPEAK = {"en": "the of and to in that is was for with", "de": "der die und in den von zu das mit sich", "fr": "le la les et des en un du une que"}


def plain_profile(text):
    """The sum of a text's trigram vectors, one trigram after the other; None without letters."""
    table, cleaned = language.letter_table(), [0]
    for c in text or "":
        low = int(table[ord(c)])
        if low or cleaned[-1]:
            cleaned.append(low)
    if cleaned[-1]:
        cleaned.append(0)
    total = np.zeros(language.DIM)
    for a, b, c in zip(cleaned, cleaned[1:], cleaned[2:]):
        va, vb, vc = (language.letter_vector(x).astype(float) for x in (a, b, c))
        total += np.roll(va, 2) * np.roll(vb, 1) * vc
    return total if len(cleaned) > 2 else None


def test_language_equals_plain_profiles(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, " ".join(r.choices(SPEAK[g].split(), k=r.randint(3, 30))), g) for k in range(60) for g in [r.choice(list(SPEAK))]]
    odd = [None, "", "  12 !", "Ünder straße, ÇA", "x", "Я и ты 你好", "the  OF\tand"]
    rows += [(100 + k, t, None) for k, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {}
    for _, t, lang in rows:
        if lang:
            want[lang] = want.get(lang, 0) + plain_profile(t)
    want = {k: v / np.linalg.norm(v) for k, v in sorted(want.items())}
    got = language.learn(df)
    assert list(got) == list(want) and all(np.allclose(got[k], want[k]) for k in want)
    for kinds in (language.KINDS, 5):  # all kinds of trigrams at once, and in small steps
        monkeypatch.setattr(language, "KINDS", kinds)
        for (row, p), (_, t, _) in zip(language.profiles([t for _, t, _ in rows]), rows):
            plain = plain_profile(t)
            assert (p is None and plain is None) or np.array_equal(p, plain), t
    found = {x.doc_id: x for x in language.identify(df, got).collect()}
    for k, t, _ in rows:
        p = plain_profile(t)
        cosines = None if p is None else np.stack(list(want.values())) @ p / np.linalg.norm(p)
        assert found[k].lang_pred == ("und" if p is None else list(want)[int(np.argmax(cosines))])
        assert abs(found[k].score - (0 if p is None else max(0.0, cosines.max()))) < 1e-9
    assert language.identify(df.limit(0), got).count() == 0


def plain_score(net, text):
    """A text's score: each window through the network in double precision, one word after the other."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    H, s = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    found = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode()) if w]
    xs = []
    for w in found:
        low = w.lower()
        padded = b"\0" + low + b"\0"
        tri = [int(mix(np.array([a << 16 | b << 8 | c], np.uint64))[0]) & (toxicity.CHAR_BUCKETS - 1) for a, b, c in zip(padded, padded[1:], padded[2:])]
        h = words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), PUNCT)[2]
        xs.append(np.concatenate((p["word"][net.places(h)[0]], p["char"][tri].mean(axis=0))))
    best = 0.0
    for a, b in toxicity.windows(len(xs)):
        states = np.zeros((b - a, 2 * H))
        for d, order, part in (("f", range(a, b), slice(0, H)), ("b", range(b - 1, a - 1, -1), slice(H, 2 * H))):
            h = np.zeros(H)
            for t in order:
                g, hu = xs[t] @ p[f"w{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
                z, r = s(g[:H] + hu[:H]), s(g[H : 2 * H] + hu[H : 2 * H])
                c = np.tanh(g[2 * H :] + r * hu[2 * H :])
                h = z * h + (1 - z) * c
                states[t - a, part] = h
        e = np.tanh(states @ p["wa"]) @ p["va"]
        w = np.exp(e - e.max())
        best = max(best, float(s((w / w.sum()) @ states @ p["wo"] + p["bo"][0])))
    return best


def test_toxicity_equals_plain_windows(spark):
    r = random.Random(5)
    vocabulary = "alpha beta gamma delta moron scum Straße don't x1".split()
    texts = [" ".join(r.choices(vocabulary, k=r.choice([1, 5, 16, 17, 31, 32, 33, 48, 49, 90]))) for _ in range(40)] + [None, "", "!!", "é 你好"]
    net = toxicity.fit([t or "" for t in texts] * 2, [int("scum" in (t or "")) for t in texts] * 2, epochs=3)
    got = {x.doc_id: x.score for x in toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - plain_score(net, t)) < 1e-4, t
    assert toxicity.score_texts(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_training_memory_holds_words_and_not_bytes():
    """Texts are taken in groups, and give the same words, windows and features as all of them at once."""
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(r.randint(0, 200))) for _ in range(30)]
    one = [(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))]
    many = [(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    a, b = toxicity.Texts(one), toxicity.Texts(many)
    assert (a.kind == b.kind).all() and (a.spans == b.spans).all() and (a.owner == b.owner).all() and (a.texts_with == b.texts_with).all()
    assert all((x == y).all() for x, y in zip(a.features, b.features))
    spans = [(int(a.at[k]) + x, int(a.at[k]) + y) for k, t in enumerate(texts) for x, y in toxicity.windows(len(t.split()))]
    assert a.spans.tolist() == [list(x) for x in spans]


def test_pipeline_stages_on_odd_tables(spark):
    import pytest

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three", None, "s", 1), (1, None, None, None, None), (None, "", None, "s", 0)]
    df = spark.createDataFrame(rows, schema)
    assert corpus_pipeline.drop_unidentified(spark, df, "").count() == 3  # nothing to learn from
    assert corpus_pipeline.drop_near_duplicates(spark, df, "").count() == 3 and corpus_pipeline.encode(spark, df, "").count() == 3
    empty = df.where(F.lit(False))
    for stage in (corpus_pipeline.drop_unidentified, corpus_pipeline.drop_near_duplicates, corpus_pipeline.encode):
        assert stage(spark, empty, "").count() == 0


def test_training_texts_are_bounded_by_characters(spark, monkeypatch):
    """Long training texts: fewer of them reach the driver, whole ones; a text beyond a tenth of the bound teaches nothing."""
    from brindle.llm import toxicity

    texts = [(k, ("bad " if k % 2 else "good ") * 100) for k in range(400)] + [(1000, "bad " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t.startswith("bad"))) for k, t in texts], "doc_id long, toxic int")
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda column, y, **how: got.append((column.to_pylist(), y)))
    toxicity.learn(docs, labels, most_chars=50_000)
    toxicity.learn(docs, labels)
    (some, y), (every, _) = got
    assert 50 < len(some) < 170 and len(set(y)) == 2 and all(t in {x for _, x in texts[:400]} for t in some) and len(every) == 401


def test_language_learns_from_all_rows(spark):
    """Prototypes and floors of more rows than a sample of 1,500 a language held (F4)."""
    r = random.Random(4)
    words = {"a": "the of and worth less more some".split(), "b": "der die und mehr oder wenig kaum".split()}
    rows = [(k, " ".join(r.choices(words[lang], k=r.randint(1, 12))), lang) for k, lang in enumerate(["a", "b"] * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sums = {lang: sum(p.astype(np.float64) for _, p in language.profiles([t for _, t, own in rows if own == lang])) for lang in words}
    got = language.learn(df)
    assert all(np.allclose(got[k], v / np.linalg.norm(v), atol=1e-12) for k, v in sums.items()) and len(got) == 2
    matrix, scores = np.stack([got["a"], got["b"]]), {}
    for _, t, _ in rows:
        heads = [h[0] for n in language.HEADS if n < len(t) and (h := t[: n + 1].rsplit(None, 1)) and h[0]]
        for _, p, n in language.counted_profiles([t, *heads]):
            if p is not None:
                scores.setdefault(language.size_class(n), []).append(float((matrix @ p).max() / np.linalg.norm(p.astype(np.float64))))
    floors = language.learn_floors(df, got)
    assert set(floors) == set(scores)
    for k, own in scores.items():
        at = sorted(own)[int(language.FLOOR_TAIL * (len(own) - 1))]
        assert language.FLOOR_SHARE * (at - 1.5 / language.STEPS) <= floors[k] <= language.FLOOR_SHARE * (at + 1e-9)
