"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask names the token places of a window that count; the others are ignored, so a substituted word at an ignored place
does no harm, and several masks cover different places. Hashes of all windows of the benchmark and of the documents are
joined; hits of one document and item on one diagonal (the same shift between them) are merged, and the stretch from
the first to the last of them is compared token by token. Where too few of its tokens are equal, the best stretch from
one of the diagonal's hits to another is taken, so that copies with other words between them do not hide each other.
Items shorter than the masks are looked for whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from brindle.session import materialize

#: Places that count in a window of SPAN tokens, eight in each mask.
MASKS = ((0, 1, 2, 4, 7, 8, 10, 11), (0, 1, 3, 4, 6, 9, 10, 11), (0, 2, 3, 5, 6, 8, 9, 11), (0, 1, 2, 3, 5, 7, 9, 11))
SPAN = 12
#: Up to so many benchmark seeds (about 40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("a"))


def _masks(short: list[int]) -> list[tuple[int, ...]]:
    return [*MASKS, *(tuple(range(n)) for n in short)]


def _seeds(hashed: DataFrame, key: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """(key, pos, seed) of every window that fits; a mask of a short item's length is dense."""
    n = F.size("a")
    least = min(m[-1] + 1 for m in masks)
    placed = hashed.where(n >= least).select(key, "a", n.alias("n"), F.explode(F.sequence(F.lit(0), n - least)).alias("pos"))
    each = [
        F.when(F.col("pos") + (m[-1] + 1) <= F.col("n"), F.xxhash64(F.lit(k), *(F.get("a", F.col("pos") + o) for o in m)))
        for k, m in enumerate(masks)
    ]
    return placed.select(key, "pos", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _best_between_hits(same: Column, share: float) -> Column:
    """struct<n, lo, hi> of the stretch with most equal tokens that starts with a hit, ends with a hit and passes; n is -1 without one.

    same: 1 (equal) or 0 for each place of a diagonal. A place weighs 1 - share or -share, and a stretch passes if the sum
    of weights before its end is no less than that before its start. One walk over starts (with the least sum so far) and
    ends (with the greatest sum still to come) meets, for each start of use, its last end: two steps for each hit."""

    def walk(c: Column, w: Column) -> Column:
        weight = lambda at: F.round((F.get(c, at) - F.lit(share) * at) * 1e6).cast("long")
        rest = F.reverse(F.aggregate(F.reverse(w), F.array().cast("array<bigint>"), lambda s, p: F.concat(s, F.array(F.greatest(F.try_element_at(s, F.lit(-1)), weight(p + SPAN))))))

        def step(m: Column):
            def f(s: Column, _: Column) -> Column:
                i, j = s["i"], s["j"]
                a, b = F.get(w, i), F.get(w, j) + SPAN
                low = F.least(s["low"], weight(a))
                n = F.get(c, b) - F.get(c, a)
                fits = F.get(m, j) >= low
                better = fits & (j >= i) & ((n > s["n"]) | ((n == s["n"]) & (a == s["lo"])))
                new = F.struct(
                    F.when(fits, i).otherwise(i + 1).alias("i"), F.when(fits, j + 1).otherwise(j).alias("j"), low.alias("low"),
                    F.when(better, n).otherwise(s["n"]).alias("n"), F.when(better, a).otherwise(s["lo"]).alias("lo"), F.when(better, b).otherwise(s["hi"]).alias("hi"),
                )
                return F.when((i < F.size(w)) & (j < F.size(w)), new).otherwise(s)

            return f

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(1 << 62).alias("low"), F.lit(-1).alias("n"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
        return _let(rest, lambda m: F.aggregate(F.sequence(F.lit(1), 2 * F.size(w)), start, step(m), lambda s: F.struct(s["n"].alias("n"), s["lo"].alias("lo"), s["hi"].alias("hi"))))

    def hits(x: Column) -> Column:
        full = lambda p: reduce(or_, (reduce(and_, (F.get(x, p + o) == 1 for o in m)) for m in MASKS))
        return F.filter(F.sequence(F.lit(0), F.size(x) - SPAN), full)

    sums = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda s, y: F.concat(s, F.array(F.element_at(s, -1) + y)))
    return _let(same, lambda x: _let(sums(x), lambda c: _let(hits(x), lambda w: walk(c, w))))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_same): stretches that a document shares with an item.

    docs (doc_id, text, ...), benchmark (item_id, text, ...). A stretch runs from the start of a hit of a seed to the end of
    that or a later hit of the same shift; it has at least ``least`` tokens, or the whole item if that is shorter, of which
    at least ``share`` are the same. Of several stretches of one pair the one with most equal
    tokens is returned (then the earliest in the item, then in the document). Rows with a null id, and null or empty texts,
    share nothing; rows that repeat an id are each compared, and count as one document or item. Other columns are ignored."""
    items = _hashed(benchmark, "item_id").distinct()
    lengths = items.where((F.size("a") > 0) & (F.size("a") < SPAN)).select(F.size("a").alias("n")).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most SPAN - 1 numbers
    masks = _masks(short)
    span = F.lit(SPAN)
    for k, m in enumerate(masks[len(MASKS):]):
        span = F.when(F.col("mask") == len(MASKS) + k, F.lit(len(m))).otherwise(span)
    # a short item has its dense mask only, others the spaced ones
    wanted = items.withColumn("n", F.size("a"))
    n = F.col("n")
    placed = wanted.where(n > 0).select("item_id", "a", "n", F.explode(F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0)))).alias("item_pos"))
    each = [
        F.when(
            (n >= SPAN) if k < len(MASKS) else (n == len(m)),
            F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *(F.get("a", F.col("item_pos") + o) for o in m)).alias("seed")),
        )
        for k, m in enumerate(masks)
    ]
    seeds = placed.select("item_id", "item_pos", F.explode(F.array(*each)).alias("x")).where("x is not null").select("item_id", "item_pos", "x.mask", "x.seed")
    seeds = seeds.select("item_id", "item_pos", "seed", (F.col("item_pos") + span).alias("item_end")).distinct()
    # an item of n tokens has at least n / SPAN seeds, so few seeds also mean few tokens
    few = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    seeds = F.broadcast(seeds) if few else seeds.hint("merge")
    items = F.broadcast(items) if few else items

    hits = _seeds(_hashed(docs, "doc_id"), "doc_id", masks).join(seeds, "seed")
    lines = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min("item_pos").alias("lo"), F.max("item_end").alias("hi"))
    lines = materialize(lines, "diagonals")
    # only documents with a hit are read and shuffled again
    ids = lines.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS else ids.hint("merge")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    both = lines.join(_hashed(texts, "doc_id"), "doc_id").join(items.withColumnRenamed("a", "b"), "item_id")
    equal = F.transform(F.sequence(F.col("lo"), F.col("hi") - 1), lambda i: F.when(F.get("a", i + F.col("shift")) == F.get("b", i), 1).otherwise(0))
    inside = both.where("hi <= size(b) and lo + shift >= 0 and hi + shift <= size(a)")
    whole = inside.select("doc_id", "item_id", "shift", "lo", "hi", F.size("b").alias("n_item"), equal.alias("same"))
    passes = lambda n, size: (size >= F.least(F.lit(least), F.col("n_item"))) & (n >= share * size)
    size, n = F.col("hi") - F.col("lo"), F.aggregate("same", F.lit(0), lambda s, x: s + x)
    # a hit of a spaced mask is SPAN long, so a longer stretch holds several
    x = F.when(passes(n, size), F.struct(n.alias("n"), F.lit(0).alias("lo"), size.alias("hi"))).when(size > SPAN, _best_between_hits(F.col("same"), share))
    found = whole.withColumn("x", x).where("x is not null").select(
        "doc_id", "item_id", "shift", "n_item", (F.col("lo") + F.col("x.lo")).alias("lo"), (F.col("lo") + F.col("x.hi")).alias("hi"), F.col("x.n").alias("n_same")
    )
    found = found.where((F.col("n_same") >= 0) & passes(F.col("n_same"), F.col("hi") - F.col("lo")))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", (-F.col("lo")).alias("a"), (-F.col("shift")).alias("b"), "hi")).alias("x"))
    return best.select(
        "doc_id", "item_id", (-F.col("x.a") - F.col("x.b")).alias("doc_start"), (-F.col("x.a")).alias("item_start"),
        (F.col("x.hi") + F.col("x.a")).alias("n_tokens"), F.col("x.n_same").alias("n_same"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that share no stretch with the benchmark."""
    found = contaminated(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(found.withColumnRenamed("doc_id", "_hit"), F.col("doc_id").cast("long") == F.col("_hit"), "left_anti")


def oracle(documents: str = "documents") -> str:
    """The definition in DuckDB SQL: every stretch from one hit to another of its diagonal is counted, token by token."""
    masks = ", ".join(f"({k}, {list(m)})" for k, m in enumerate(MASKS))
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH masks(mask, places) AS (VALUES {masks}),
b AS (SELECT DISTINCT item_id, {words} AS b FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, {words} AS a FROM {documents} WHERE doc_id IS NOT NULL),
shapes AS (SELECT mask, places, {SPAN} AS span FROM masks
  UNION ALL SELECT DISTINCT 100 + len(b), range(len(b)), len(b) FROM b WHERE len(b) BETWEEN 1 AND {SPAN - 1}),
bp AS (SELECT item_id, b, unnest(range(0, greatest(len(b) - {SPAN}, 0) + 1)) AS p FROM b WHERE len(b) > 0),
seeds AS (SELECT DISTINCT item_id, p AS item_pos, p + span AS item_end, mask, array_to_string(list_transform(places, lambda o: b[p + o + 1]), ' ') AS seed
  FROM bp, shapes WHERE CASE WHEN mask < 100 THEN len(b) >= {SPAN} ELSE len(b) = span END),
dp AS (SELECT doc_id, a, unnest(range(0, len(a))) AS p FROM d),
dseeds AS (SELECT doc_id, p AS pos, mask, array_to_string(list_transform(places, lambda o: a[p + o + 1]), ' ') AS seed FROM dp, shapes WHERE p + span <= len(a)),
hits AS (SELECT DISTINCT doc_id, item_id, pos - item_pos AS shift, item_pos, item_end FROM dseeds JOIN seeds USING (mask, seed)),
spans AS (SELECT DISTINCT doc_id, item_id, shift, x.item_pos AS lo, y.item_end AS hi FROM hits x JOIN hits y USING (doc_id, item_id, shift) WHERE y.item_pos >= x.item_pos),
found AS (SELECT doc_id, item_id, shift, lo, hi, len(b) AS n_item, len(list_filter(range(lo, hi), lambda i: a[i + shift + 1] = b[i + 1])) AS n_same
  FROM spans JOIN d USING (doc_id) JOIN b USING (item_id)),
good AS (SELECT * FROM found WHERE hi - lo >= least({SPAN}, n_item) AND n_same >= 0.8 * (hi - lo))
SELECT doc_id, item_id, lo + shift AS doc_start, lo AS item_start, hi - lo AS n_tokens, n_same FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_same DESC, lo, shift, hi DESC) = 1"""
