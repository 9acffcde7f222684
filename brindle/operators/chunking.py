"""Documents to chunks: paragraphs or Markdown blocks packed up to a size, then numbered."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.scalars import strip
from brindle.session import ship_package

MAX_CHARS, LEAST = 1000, 5


def pack_text(text: str, max_chars: int) -> list[str]:
    """Greedy packing of paragraphs, a blank line between them; the joiner isn't counted, and no paragraph is split.

    A loop in a worker costs the length of the text; an array fold in the JVM would copy what it has at every step."""
    out, held, size = [], [], 0
    for part in text.split("\n\n"):
        if size and size + len(part) > max_chars:
            out.append("\n\n".join(held).strip())
            held, size = [], 0
        if size or part:  # an empty paragraph at the start of a chunk leaves nothing
            held.append(part)
            size += len(part) + (2 if size else 0)
    last = "\n\n".join(held).strip()
    return out + [last] * bool(last)


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>")
_LINK = re.compile(r" {0,3}\[[^\]\n]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:/?[a-zA-Z][\w-]*(?:[ \t/>]|$)|!--|\?|![A-Z])")
_INDENTED = re.compile(r"(?: {4}|\t)")


def markdown_blocks(text: str) -> list[tuple[str, bool]]:
    """(block, is a fence) for the top-level blocks, cut at line feeds; link definitions and blank lines are no blocks."""
    lines = text.split("\n")
    out: list[tuple[str, bool]] = []
    n, i = len(lines), 0
    blank = lambda k: not lines[k].strip()

    def opens(k: int) -> bool:
        """Whether the line begins another block in the midst of a paragraph."""
        s = lines[k]
        item = _ITEM.match(s)
        fence = _FENCE.match(s)
        return bool(
            _HEADING.match(s) or _BREAK.match(s) or _QUOTE.match(s) or (fence and not (fence[1][0] == "`" and "`" in fence[2])) or _HTML.match(s)
            or (item and s[item.end():].strip() and (item[2] in "-+*" or item[2][:-1] == "1"))
        )

    while i < n:
        if blank(i):
            i += 1
            continue
        start, s = i, lines[i]
        fence = _FENCE.match(s)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            mark = fence[1]
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            i += 1
            while i < n and not close.match(lines[i]):
                i += 1
            i = min(i + 1, n)
            out.append(("\n".join(lines[start:i]) + "\n", True))
            continue
        if _HEADING.match(s) or _BREAK.match(s):
            i += 1
        elif _LINK.match(s):
            i += 1
            continue
        elif _INDENTED.match(s):
            while i < n and (blank(i) or _INDENTED.match(lines[i])):
                i += 1
            while blank(i - 1):
                i -= 1
        elif (item := _ITEM.match(s)) is not None:
            i += 1
            while i < n:
                if blank(i):
                    k = i
                    while k < n and blank(k):
                        k += 1
                    again = _ITEM.match(lines[k]) if k < n else None
                    if k < n and (len(lines[k]) - len(lines[k].lstrip()) >= len(item[1]) + len(item[2]) + 1 or (again and again[2][-1] == item[2][-1] and not _BREAK.match(lines[k]))):
                        i = k
                        continue
                    break
                inner = len(lines[i]) - len(lines[i].lstrip()) >= len(item[1]) + len(item[2]) + 1
                again = _ITEM.match(lines[i])
                if not inner and not (again and again[2][-1] == item[2][-1]) and (opens(i) or again):
                    break
                i += 1
        elif _QUOTE.match(s):
            i += 1
            while i < n and not blank(i) and (_QUOTE.match(lines[i]) or not opens(i)):
                i += 1
        elif _HTML.match(s):
            if s.lstrip().startswith("<!--"):
                while i < n and "-->" not in lines[i]:
                    i += 1
                i = min(i + 1, n)
            else:
                while i < n and not blank(i):
                    i += 1
        else:
            i += 1
            while i < n and not blank(i):
                if _UNDERLINE.match(lines[i]):
                    i += 1
                    break
                if opens(i):
                    break
                i += 1
        out.append(("\n".join(lines[start:i]) + "\n", False))
    return out


def pack_markdown(text: str, max_chars: int) -> list[str]:
    """Fences stand alone whatever their size; other blocks are packed like paragraphs."""
    out, cur = [], ""
    for block, fence in markdown_blocks(text):
        if fence:
            if cur.strip():
                out.append(cur.strip())
            out.append(block.strip())
            cur = ""
        elif cur.strip() and len(cur) + len(block) > max_chars:
            out.append(cur.strip())
            cur = block
        else:
            cur = f"{cur}\n\n{block.strip()}" if cur else block.strip()
    return out + ([cur.strip()] if cur.strip() else [])


def _packer(pack, max_chars: int):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else pack(t, max_chars))

    return run


def number(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, text, source, content_hash, node_type, parent_scope, line_range) of (filepath, content_hash, texts): noise dropped, then numbered from 0."""
    kept = F.filter("texts", lambda t: F.length(strip(t)) >= least)
    rows = docs.select("filepath", "content_hash", F.posexplode(kept).alias("pos", "text"))
    none = [F.lit(None).cast("string").alias(c) for c in ("node_type", "parent_scope", "line_range")]
    return rows.select(F.concat("filepath", F.lit("_chunk_"), F.col("pos").cast("string")).alias("id"), strip(F.col("text")).alias("text"), F.col("filepath").alias("source"), "content_hash", *none)


def chunk_text(docs: DataFrame, max_chars: int = MAX_CHARS, *, least: int = LEAST) -> DataFrame:
    """Chunks of documents (filepath, content, content_hash) by paragraphs."""
    ship_package(docs.sparkSession)
    return number(docs.withColumn("texts", _packer(pack_text, max_chars or MAX_CHARS)("content")), least)


def chunk_markdown(docs: DataFrame, max_chars: int = MAX_CHARS, *, least: int = LEAST) -> DataFrame:
    """Chunks of Markdown documents; code fences are never split or joined."""
    ship_package(docs.sparkSession)
    return number(docs.withColumn("texts", _packer(pack_markdown, max_chars or MAX_CHARS)("content")), least)


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Markdown by blocks where the path ends in .md, all else by paragraphs."""
    md = F.lower("filepath").endswith(".md")
    return chunk_markdown(docs.where(md), max_chars).unionByName(chunk_text(docs.where(~md), max_chars))
