"""Licence scans: TF-IDF cosine of stretches of text to licence templates, then inheritance from the nearest directory.

A template is a header, a statement, a short licence's body or how a long one's body begins. Terms are weighted by their
inverse frequency among the templates, a term of none of them as the rarest. A text's score for a template is the
greatest cosine of any of its stretches of the template's number of terms (or of the whole text, if that is shorter).
Templates of whose squared weights a text holds too little to reach the threshold (Cauchy-Schwarz) are left out; of the
others all stretches are told at once, as a stretch's norm follows from that of the one before by how often the term that
leaves and the term that comes occur in it. Licences of one family differ in few words ("or later", a version), which a
changed word elsewhere must not outweigh: where two templates are nearly as near to the same place, the words that only
one of them has decide. A text that holds a body's beginning has that licence, whatever headers follow. An
SPDX-License-Identifier tag names its licence itself. A file without a licence takes that of the nearest directory above
it which holds a licence file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.licence_texts import BODIES, TEMPLATES
from brindle.llm.skew import salted_join
from brindle.llm.textvec import groups, words
from brindle.session import materialize, ship_package

#: Terms are runs of ASCII letters and digits.
APART = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    APART[_a:_b] = False
#: Above the weight of any one term in a template, so that one word repeated never passes.
LEAST = 0.87
#: Templates whose cosines to one place differ by less are told apart by the words that only one of them has.
NEAR = 0.08
#: The cosine of a whole text to a template from which the licence is the greater part of the text.
MOSTLY = 0.5
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+:-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+:-]+)*)", re.I)


def term_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), APART)[2]


class Matcher:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, bodies: tuple[tuple[str, str], ...] = BODIES):
        templates = (*templates, *bodies)
        self.least, self.names = least, [n for n, _ in templates]
        self.body = np.arange(len(templates)) >= len(templates) - len(bodies)
        terms = [term_hashes(t) for _, t in templates]
        self.lengths = np.array([len(t) for t in terms])
        self.vocabulary, held = np.unique(np.concatenate([np.unique(t) for t in terms]), return_counts=True)
        # the last place stands for all terms outside the templates
        self.idf = np.append(np.log((1 + len(terms)) / (1 + held)) + 1, np.log(1 + len(terms)) + 1)
        self.counts = np.stack([np.bincount(np.searchsorted(self.vocabulary, t), minlength=len(self.idf)) for t in terms])
        self.vectors = self.counts * self.idf
        self.vectors /= np.linalg.norm(self.vectors, axis=1)[:, None]
        self.squares = (self.vectors**2).T
        # of templates that are equally near the longer one says more
        self.longest_first = np.argsort(-self.lengths, kind="stable")

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def cosine(self, k: int, places: np.ndarray, hashes: np.ndarray) -> float:
        """Of one stretch, in full: repeated terms count with their number."""
        _, head, count = np.unique(hashes, return_index=True, return_counts=True)
        weight = count * self.idf[places[head]]
        return float(weight @ self.vectors[k][places[head]]) / float(np.sqrt(weight @ weight))

    def nearest(self, k: int, places: np.ndarray, hashes: np.ndarray, order: "_Order") -> tuple[float, int]:
        """(the greatest cosine to template k of any stretch, where it begins); the leftmost of equals, to a rounding error."""
        n, size = len(places), int(self.lengths[k])
        if n <= size:
            return self.cosine(k, places, hashes), 0
        idf = self.idf[places]
        dots = np.concatenate(([0.0], np.cumsum(self.vectors[k][places] * idf)))
        came, left = order.within(size)
        square = idf**2
        change = square[size:] * (2 * came[size:] + 1) - square[: n - size] * (2 * left[: n - size] + 1)
        norm = (square[:size] * (2 * came[:size] + 1)).sum() + np.concatenate(([0.0], np.cumsum(change)))
        score = (dots[size:] - dots[:-size]) / np.sqrt(norm)
        at = int(np.flatnonzero(score >= score.max() - 1e-9)[0])
        return self.cosine(k, places[at : at + size], hashes[at : at + size]), at

    def evidence(self, k: int, j: int, seen: np.ndarray) -> tuple[float, float]:
        """Of the words that template k has beyond j, and j beyond k, the weighted shares among seen, the counts of a place's words."""
        both = np.minimum(self.counts[k], self.counts[j])
        extra = np.maximum(seen - both, 0)
        share = []
        for t in (k, j):
            own = self.counts[t] - both
            total = float((own * self.idf).sum())
            share.append(float((np.minimum(extra, own) * self.idf).sum()) / total if total else None)
        a, b = share
        if a is None and b is None:
            return 0.0, 0.0
        # one that has no words of its own is told by the lack of the other's
        return (1 - b if a is None else a), (1 - a if b is None else b)

    def choose(self, found: list[tuple[float, int, int]], places: np.ndarray) -> tuple[int, float]:
        """Of (cosine, template, place), the best first, the template whose own words speak for it, and its cosine."""
        best, k, at = found[0]
        for score, j, to in found[1:]:
            if score < found[0][0] - NEAR:
                break
            a, b = min(at, to), max(at + int(self.lengths[k]), to + int(self.lengths[j]))
            if self.names[j] == self.names[k] or b - a >= self.lengths[k] + self.lengths[j]:
                continue
            seen = np.bincount(places[a:b], minlength=len(self.idf))
            mine, other = self.evidence(k, j, seen)
            if other > mine:
                best, k, at = score, j, to
        return k, best

    def scan(self, column: pa.Array) -> Iterator[tuple[int, str, float, float]]:
        """(row, identifier, score, whole) of the texts with a licence; whole: the greatest cosine of the text as one stretch."""
        for first, last, raw, offsets in groups(column):
            _, _, hashes, at = words(raw, offsets, APART)
            places = self.places(hashes)
            owner = np.repeat(np.arange(last - first), np.diff(at))
            known = places < len(self.vocabulary)
            present = np.zeros((last - first, len(self.idf)), np.float32)
            present[owner[known], places[known]] = 1
            possible = present @ self.squares >= self.least**2 - 1e-6
            for row in np.flatnonzero(possible.any(axis=1)):
                own = slice(at[row], at[row + 1])
                order, found, whole = _Order(hashes[own]), [], 0.0
                for k in self.longest_first[possible[row][self.longest_first]]:
                    score, at_ = self.nearest(k, places[own], hashes[own], order)
                    if score >= self.least:
                        found.append((score, int(k), at_))
                        whole = max(whole, score if self.body[k] else self.cosine(k, places[own], hashes[own]))
                if found:
                    # a body before headers; of equals the longer, which came first
                    found = [f for f in found if self.body[f[1]]] or found
                    found.sort(key=lambda f: -round(f[0], 12))
                    k, score = self.choose(found, places[own])
                    yield first + int(row), self.names[k], min(1.0, score), min(1.0, whole)


class _Order:
    """The places of each term of a text, to tell how often a term occurs in the stretch before or behind its place."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        _, kind = np.unique(hashes, return_inverse=True)
        self.key = kind.astype(np.int64) * (2 * self.n + 1) + np.arange(self.n)
        self.sorted = np.sort(self.key)
        self.rank = np.searchsorted(self.sorted, self.key)
        self.first = kind.astype(np.int64) * (2 * self.n + 1)

    def within(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place, its term's other occurrences among the size - 1 places before it, and among those behind it."""
        before = self.rank - np.searchsorted(self.sorted, np.maximum(self.key - (size - 1), self.first))
        behind = np.searchsorted(self.sorted, self.key + size) - self.rank - 1
        return before, behind


def own_licences(files: DataFrame, *, least: float = LEAST, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(path, licence, score, whole) for files (path, text, ...), one row each; licence is null and score 0 where no template is near.

    whole is the cosine of the whole text to a template, or that of a long licence's beginning, so it tells licence texts
    from files that carry a header."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            names, score, whole = [None] * n, np.zeros(n), np.zeros(n)
            for row, name, s, w in matcher.scan(texts):
                names[row], score[row], whole[row] = name, s, w
            for row in np.flatnonzero(pc.match_substring(texts, "spdx-license-identifier", ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)):
                if tag := SPDX.search(texts[row].as_py()):
                    names[row], score[row] = " ".join(tag[1].split()), 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(whole)], names=["path", "licence", "score", "whole"])

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, "path string, licence string, score double, whole double")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, is_licence_file: Column | None = None, *, least: float = LEAST, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(path, licence, score, origin, source_path) for files (path, text, ...), one row for each input row.

    origin: own, inherited or none. is_licence_file is a condition on path, licence, score and whole; by default the file's
    name begins with licen[cs]e, copying, unlicense or notice. Of several licence files in a directory the path that sorts
    first counts. A null path has no directory; null and empty texts have no licence of their own; texts of any length are
    scanned whole. Other columns are ignored; an empty table gives an empty result."""
    if is_licence_file is None:
        is_licence_file = F.lower(F.regexp_extract("path", "[^/]*$", 0)).rlike("^(licen[cs]e|copying|unlicense|notice)")
    own = materialize(own_licences(files, least=least, templates=templates), "licences")
    given_out = own.where(F.col("licence").isNotNull() & F.col("path").isNotNull() & is_licence_file)
    of_dir = given_out.groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "licence", "score")).alias("x"))
    bare = own.where(F.col("licence").isNull())
    # directories, not files, look for their nearest ancestor
    dirs = bare.where("path is not null").select(parent(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    above = dirs.select("home", F.explode(up).alias("a")).select("home", "a.depth", "a.dir")
    nearest = above.hint("merge").join(of_dir.hint("merge"), "dir").groupBy("home").agg(F.max_by("x", "depth").alias("x"))
    given = salted_join(bare.select("path", parent(F.col("path")).alias("home")), nearest, ["home"], "left").select(
        "path", F.col("x.licence").alias("licence"), F.coalesce("x.score", F.lit(0.0)).alias("score"),
        F.when(F.col("x").isNull(), "none").otherwise("inherited").alias("origin"), F.col("x.path").alias("source_path"),
    )
    kept = own.where(F.col("licence").isNotNull()).select("path", "licence", "score", F.lit("own").alias("origin"), F.col("path").alias("source_path"))
    return kept.unionByName(given)
