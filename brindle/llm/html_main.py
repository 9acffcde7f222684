"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page, using the whole page as context.

A block's input is the mean vector of its path (tags, classes, ids), the mean vector of its hashed words, and a few
sizes. The network is trained here on generated pages: layouts, class names and texts are drawn at random, and each
block's label is known from the part of the page it was made for. Nothing of the corpus is needed for that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm.html_blocks import Page, parse
from brindle.llm.textvec import PUNCT, groups, words
from brindle.session import ship_package

PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, SIZES, HIDDEN = 1 << 13, 1 << 12, 16, 6, 6, 16
INPUT = PATH_DIM + WORD_DIM + SIZES
#: Places of pages of like length that run together, the empty ones behind shorter pages included; a longer page runs alone.
PADDED = 1 << 13
#: Code points of html that are worked on together; a longer page is worked on alone.
TOGETHER = 1 << 20


@lru_cache(maxsize=1 << 16)
def path_bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_BUCKETS


class Features:
    """Features of a list of pages' blocks: flat arrays over all blocks.

    A block's path is summed along the tree of elements, so that deep pages cost no more than their tags."""

    def __init__(self, pages: list[Page]):
        flat = [b for p in pages for b in p.blocks]
        self.lengths = np.array([len(p.blocks) for p in pages], np.int64)
        # element 0 stands for blocks outside all elements
        names, parents, node, base = [[path_bucket("")]], [-1], [], 1
        for p in pages:
            for e in p.elements:
                names.append([path_bucket(x) for x in e.names])
                parents.append(e.parent + base if e.parent >= 0 else -1)
            node += [b.node + base if b.node >= 0 else 0 for b in p.blocks]
            base += len(p.elements)
        size = np.array([len(x) for x in names], np.int64)
        self.name = np.array([x for own in names for x in own], np.int64)
        self.name_first = np.cumsum(size) - size
        self.name_element = np.repeat(np.arange(len(names)), size)
        self.parents, self.node = np.array(parents, np.int64), np.array(node, np.int64)
        kinds, owners = [], []
        if flat:
            for a, b, raw, offsets in groups(pa.array([x.text for x in flat], pa.large_string())):
                _, _, h, at = words(raw, offsets, PUNCT)
                kinds.append((h % np.uint64(WORD_BUCKETS)).astype(np.int64))
                owners.append(np.repeat(np.arange(a, b), np.diff(at)))
        self.word = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
        self.word_block = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        n = np.array([len(b.text) for b in flat], np.float32)
        count = np.bincount(self.word_block, minlength=len(flat)).astype(np.float32)
        self.word_count = np.maximum(count, 1)
        place = np.concatenate([np.arange(k) / max(k, 1) for k in self.lengths]) if flat else np.zeros(0)
        ends = np.array([b.text[-1:] in ".!?:;…。" for b in flat], np.float32)
        link = np.array([b.link_chars for b in flat], np.float32) / np.maximum(n, 1)
        columns = (np.log1p(n) / 5, np.log1p(count) / 4, link, ends, place.astype(np.float32), np.ones(len(flat), np.float32))
        self.sizes = np.stack(columns, axis=1).astype(np.float32) if flat else np.zeros((0, SIZES), np.float32)

    def along_paths(self, own: np.ndarray) -> np.ndarray:
        """For each block the sum of a row for each element over all elements around it."""
        total = own.astype(np.float64)
        for k, up in enumerate(self.parents.tolist()):
            if up >= 0:
                total[k] += total[up]
        return total[self.node]

    def back_along_paths(self, of_block: np.ndarray) -> np.ndarray:
        """For each element the sum of a row for each block over all blocks in it: the transpose of along_paths."""
        total = np.stack([np.bincount(self.node, of_block[:, j], len(self.parents)) for j in range(of_block.shape[1])], axis=1)
        for k in range(len(self.parents) - 1, -1, -1):
            if self.parents[k] >= 0:
                total[self.parents[k]] += total[k]
        return total

    def index(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, page) places into the flat blocks, and where a block stands."""
        starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        n = self.lengths[which]
        t = np.arange(max(1, n.max(initial=0)))[:, None]
        mask = t < n[None, :]
        return np.where(mask, starts[which][None, :] + t, 0), mask.astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Labeller:
    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.2: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"path": f(PATH_BUCKETS, PATH_DIM, scale=0.02), "word": f(WORD_BUCKETS, WORD_DIM, scale=0.02), "wo": f(2 * HIDDEN + INPUT), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(INPUT, 4 * HIDDEN), f"u{d}": f(HIDDEN, 4 * HIDDEN), f"b{d}": np.concatenate((np.ones(HIDDEN), np.zeros(3 * HIDDEN))).astype(np.float32)}

    def inputs(self, page: Features) -> np.ndarray:
        n = len(page.sizes)
        if not n:
            return np.zeros((0, INPUT), np.float32)
        path = page.along_paths(np.add.reduceat(self.p["path"][page.name], page.name_first, axis=0))
        word = np.stack([np.bincount(page.word_block, self.p["word"][page.word, j], n) for j in range(WORD_DIM)], axis=1) / page.word_count[:, None]
        return np.concatenate((path.astype(np.float32), word.astype(np.float32), page.sizes), axis=1)

    def run(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probability of main text for each (time, page)."""
        p, H, (steps, n) = self.p, HIDDEN, index.shape
        states = np.zeros((steps, n, 2 * H), np.float32)
        for k, d in enumerate("fb"):
            gates = x @ p[f"w{d}"] + p[f"b{d}"]
            h, c, held = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32), [None] * steps if keep is not None else None
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = gates[index[t]] + h @ p[f"u{d}"]
                s = sigmoid(g[:, : 3 * H])
                v = np.tanh(g[:, 3 * H :])
                m = mask[t][:, None]
                c_new = s[:, :H] * c + s[:, H : 2 * H] * v
                q = np.tanh(c_new)
                if held is not None:  # only a gradient reads them
                    held[t] = (h, c, s, v, q)
                h = m * (s[:, 2 * H :] * q) + (1 - m) * h
                c = m * c_new + (1 - m) * c
                states[t, :, k * H : (k + 1) * H] = h
            if keep is not None:
                keep[d] = held
        if keep is not None:
            keep["states"] = states
        return sigmoid(states @ p["wo"][: 2 * H] + (x @ p["wo"][2 * H :])[index] + p["bo"])

    def gradient(self, page: Features, which: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        p, H = self.p, HIDDEN
        index, mask = page.index(which)
        keep: dict = {}
        d_logit = ((self.run(x, index, mask, keep) - y[index]) * mask / max(1.0, mask.sum())).astype(np.float32)
        states, at = keep["states"], index.ravel()
        g = {"bo": d_logit.sum(keepdims=True).reshape(1)}
        per_block = np.bincount(at, d_logit.ravel(), len(x)).astype(np.float32)
        g["wo"] = np.concatenate((np.einsum("tn,tnk->k", d_logit, states), x.T @ per_block))
        dx = per_block[:, None] * p["wo"][2 * H :]
        d_states = d_logit[:, :, None] * p["wo"][: 2 * H]
        steps = len(index)
        for k, d in enumerate("fb"):
            du = np.zeros_like(p[f"u{d}"])
            dh, dc, flat = np.zeros((index.shape[1], H), np.float32), np.zeros((index.shape[1], H), np.float32), np.empty((*index.shape, 4 * H), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, c, s, v, q = keep[d][t]
                m = mask[t][:, None]
                dh = dh + d_states[t, :, k * H : (k + 1) * H]
                dn = dh * m
                dcn = dc * m + dn * s[:, 2 * H :] * (1 - q * q)
                gs = np.concatenate((dcn * c, dcn * v, dn * q), axis=1) * s * (1 - s)
                dg = np.concatenate((gs, dcn * s[:, H : 2 * H] * (1 - v * v)), axis=1)
                flat[t] = dg
                du += h.T @ dg
                dh = dh * (1 - m) + dg @ p[f"u{d}"].T
                dc = dc * (1 - m) + dcn * s[:, :H]
            rows = flat.reshape(-1, 4 * H)
            gates = np.zeros((len(x), 4 * H), np.float32)
            live = mask.ravel() > 0
            gates[at[live]] = rows[live]  # each block stands in one place
            g[f"u{d}"], g[f"b{d}"], g[f"w{d}"] = du, gates.sum(axis=0), x.T @ gates
            dx += gates @ p[f"w{d}"].T
        of_element = page.back_along_paths(dx[:, :PATH_DIM])
        g["path"] = np.stack([np.bincount(page.name, of_element[page.name_element, j], PATH_BUCKETS) for j in range(PATH_DIM)], axis=1).astype(np.float32)
        spread = dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / page.word_count[:, None]
        g["word"] = np.stack([np.bincount(page.word, spread[page.word_block, j], WORD_BUCKETS) for j in range(WORD_DIM)], axis=1).astype(np.float32)
        return g

    def labels(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of like length run together, PADDED places at once."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        page = Features(pages)
        x = self.inputs(page)
        order = np.argsort(page.lengths, kind="stable")
        order = order[page.lengths[order] > 0]
        k = 0
        while k < len(order):
            end = k + 1
            while end < len(order) and page.lengths[order[end]] * (end + 1 - k) <= PADDED:
                end += 1
            which = order[k:end]
            index, mask = page.index(which)
            q = self.run(x, index, mask) >= 0.5
            for j, w in enumerate(which):
                out[w] = q[: page.lengths[w], j]
            k = end
        return out


# ---- generated pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "an er in de la th re on ti es en ou le ra do ma ing ver sch ción eau ñ ü é ka lo mi st nt wh".split()
_MENU = "home about news contact login register menu search archive category tags next previous share tweet follow subscribe more read rss help faq terms privacy".split()
_LEGAL = "copyright all rights reserved cookies we use this site accept privacy policy terms powered by newsletter sign up your email subscribe advertisement sponsored".split()


def _word(r) -> str:
    return "".join([_SYLLABLES[k] for k in r.integers(0, len(_SYLLABLES), r.integers(1, 5)).tolist()])


def _sentence(r, low: int = 1, high: int = 18) -> str:
    s = " ".join(_word(r) for _ in range(r.integers(low, high + 1)))
    return s[:1].upper() + s[1:] + r.choice([".", ".", ".", "!", "?", ""])


def _prose(r, high: int = 5) -> str:
    return " ".join(_sentence(r) for _ in range(r.integers(1, high + 1)))


def _cut(r, choices: str) -> str:
    return str(r.choice(choices.split()))


def make_page(r: np.random.Generator) -> str:
    """A page; every text of a block begins with a mark that says its label."""
    mark = {True: "\ue001", False: "\ue000"}
    t = lambda s, main=False: mark[main] + str(s).replace("<", "&lt;")

    def attr(names: str, p: float = 0.85) -> str:
        if r.random() > p:
            return ""
        name = _cut(r, names) + _cut(r, "-box -area -wrap -block -1 -main-x _x") * (r.random() < 0.15)
        return f' {_cut(r, "class class id")}="{name}"'

    def links(k: int) -> str:
        items = "".join(f'<li><a href="/{_word(r)}">{t(r.choice(_MENU) if r.random() < 0.4 else _sentence(r, 1, 3))}</a></li>' for _ in range(k))
        return f"<ul>{items}</ul>" if r.random() < 0.8 else "".join(f'<a href="#">{t(_word(r))}</a> | ' for _ in range(1))

    def boiler(kind: str) -> str:
        say = lambda: t(_prose(r, 3) if r.random() < 0.6 else " ".join(r.choice(_LEGAL, 5)))
        if kind == "nav":
            return f'<nav{attr("nav menu navbar navigation", 0.4)}>{links(r.integers(2, 9))}</nav>' if r.random() < 0.7 else f'<div{attr("nav menu navbar navigation breadcrumb breadcrumbs topnav", 1)}>{links(r.integers(2, 8))}</div>'
        if kind == "header":
            return f'<header{attr("header site-header masthead top", 0.5)}><h1>{t(_sentence(r, 1, 4))}</h1><p>{say()}</p></header>' if r.random() < 0.6 else f'<div{attr("header masthead banner logo topbar site-title", 1)}><p>{say()}</p></div>'
        if kind == "footer":
            body = r.choice([f"&copy; {_word(r)} &middot; ", ""]) + say()
            return f'<footer{attr("footer site-footer bottom", 0.3)}>{body if r.random() < 0.5 else f"<p>{body}</p>" + links(r.integers(1, 4))}</footer>' if r.random() < 0.7 else f'<div{attr("footer copyright legal bottom", 1)}><p>{body}</p></div>'
        if kind == "ad":
            return f'<div{attr("ad ads advert advertisement sponsor sponsored promo banner-ad adsense", 1)}>{say() if r.random() < 0.6 else f"<p>{say()}</p>"}</div>'
        if kind == "side":
            tag = _cut(r, "aside aside div")
            return f'<{tag}{attr("sidebar side widget related recommended popular trending", 1 if tag == "div" else 0.6)}><h3>{t(_sentence(r, 1, 4))}</h3>{links(r.integers(1, 5)) if r.random() < 0.5 else f"<p>{say()}</p><p>{say()}</p>"}</{tag}>'
        if kind == "notice":
            return f'<div{attr("cookie cookies notice consent gdpr alert warning popup modal overlay paywall message", 1)}><p>{say()}</p>{"<button>" + t(_word(r)) + "</button>" if r.random() < 0.5 else ""}</div>'
        if kind == "form":
            return f'<form{attr("search login newsletter subscribe signup form contact", 0.6)}><label>{t(_sentence(r, 1, 4))}</label><input type="text"><button>{t(_word(r))}</button>{f"<p>{say()}</p>" if r.random() < 0.5 else ""}</form>'
        if kind == "share":
            return f'<div{attr("share social sharing follow tags meta byline author date toolbar", 1)}>{links(r.integers(1, 4)) if r.random() < 0.5 else f"<p>{say()}</p>"}</div>'
        tag, inner = _cut(r, "section div ol ul"), _cut(r, "div article li")
        own = "".join(f'<{inner}{attr("comment reply comment-body response", 0.8)}><p>{t(_prose(r, 4))}</p>{f"<p>{t(_prose(r, 2))}</p>" if r.random() < 0.3 else ""}</{inner}>' for _ in range(r.integers(1, 6)))
        return f'<{tag}{attr("comments comment-list discussion responses disqus replies", 1)}><h3>{t(_sentence(r, 1, 3))}</h3>{own}</{tag}>'

    def article() -> str:
        parts = []
        if r.random() < 0.85:
            parts.append(f"<h1>{t(_sentence(r, 1, 12), True)}</h1>")
        for _ in range(r.integers(1, 14)):
            k = r.random()
            text = lambda: t(_prose(r, 6) if r.random() < 0.8 else _sentence(r, 1, 3), True)
            if k < 0.62:
                parts.append(f"<p>{text()}</p>")
            elif k < 0.70:
                parts.append(f"<p><b>{text()}<br>")
            elif k < 0.74:
                parts.append(f'<p>{text()} <a href="/x">{_sentence(r, 1, 4)}</a> {_prose(r, 2)}</p>')
            elif k < 0.80:
                parts.append(f"<h2>{t(_sentence(r, 1, 6), True)}</h2>")
            elif k < 0.86:
                parts.append("<ul>" + "".join(f"<li>{text()}</li>" for _ in range(r.integers(1, 5))) + "</ul>")
            elif k < 0.90:
                parts.append(f"<blockquote><p>{text()}</p></blockquote>")
            elif k < 0.93:
                parts.append(f"<pre>{text()}</pre>")
            elif k < 0.96:
                parts.append(f"<table><tr><td>{text()}</td><td>{text()}</td></tr></table>")
            elif k < 0.98:
                parts.append(f"<div>{text()}</div>")
            else:
                parts.append(boiler(_cut(r, "ad share side")))
        body = "".join(parts)
        k = r.random()
        if k < 0.55:
            return f'<article{attr("post article entry story hentry", 0.4)}>{body}</article>'
        if k < 0.7:
            return f'<main{attr("main content", 0.3)}>{body}</main>'
        return f'<div{attr("content post-content article-body entry-content post main story text body page", 1)}>{body}</div>'

    before = [boiler(_cut(r, "nav nav header ad notice form side share")) for _ in range(r.integers(0, 4))]
    after = [boiler(_cut(r, "footer footer comments comments side ad form share nav notice")) for _ in range(r.integers(0, 5))]
    body = "".join(before) + article() + "".join(after)
    if r.random() < 0.3:
        body = f'<div{attr("wrapper container page site row layout", 1)}>{body}</div>'
    return f"<html><head><title>{_word(r)}</title></head><body>{body}</body></html>"


def unmarked(page: Page) -> tuple[Page, list[bool]]:
    """A generated page without its marks, and the labels that they give."""
    plain = [b._replace(text=b.text.replace("\ue000", "").replace("\ue001", "") or "x") for b in page.blocks]
    return page._replace(blocks=plain), [b.text.startswith("\ue001") for b in page.blocks]


@lru_cache(maxsize=1)
def trained(pages: int = 1500, epochs: int = 5, batch: int = 50, seed: int = 77) -> Labeller:
    """A network trained on generated pages; the same one in every run."""
    r = np.random.default_rng(seed)
    data, y = [], []
    for _ in range(pages):
        own, marks = unmarked(parse(make_page(r)))
        y += marks
        data.append(own)
    page, target = Features(data), np.array(y, np.float32)
    net, step = Labeller(), 0
    m, v = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    starts = np.concatenate(([0], np.cumsum(page.lengths)))
    for epoch in range(epochs):
        order = r.permutation(pages)
        for k in range(0, pages, batch):
            which = np.sort(order[k : k + batch])
            sub = Features([data[w] for w in which])
            own_y = np.concatenate([target[starts[w] : starts[w + 1]] for w in which])
            g = net.gradient(sub, np.arange(len(which)), own_y, net.inputs(sub))
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for name, value in g.items():
                m[name] = 0.9 * m[name] + 0.1 * value
                v[name] = 0.999 * v[name] + 0.001 * value * value
                net.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_text(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for pages (page_id, url, html, ...): the blocks labelled main text, joined by line feeds.

    One row for each input row, repeated ones included. Null and empty pages, and pages without main text, have an empty
    text; pages of any length and depth are read whole. Other columns are ignored; an empty table gives an empty result."""
    spark = pages.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast((net or trained()).p)  # under 1 MB, whatever the data
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller.__new__(Labeller)
        own.p = held.value
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(2)), 0).to_numpy(zero_copy_only=False))
            k = 0
            while k < whole.num_rows:
                before = size[k - 1] if k else 0
                end = max(k + 1, int(np.searchsorted(size, before + TOGETHER, "right")))
                batch = whole.slice(k, end - k)
                k = end
                found = [parse(x) for x in batch.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, keep in zip(p.blocks, main) if keep) for p, main in zip(found, own.labels(found))]
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
