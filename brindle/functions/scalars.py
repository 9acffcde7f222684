"""Scalar building blocks: coalescing that skips empty values, Unicode strip, hashes, coercions, cosine."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: White space as Python's str.strip has it (fixed values): the code points, as a class of a regular expression.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def nz(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def nz_num(c: Column) -> Column:
    """The number, or null if it is zero."""
    return F.when(c != 0, c)


def first_of(*cols: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*[nz(c) for c in cols])


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{WHITE}+|{WHITE}+\z", "")


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the text in UTF-8."""
    return F.substring(F.sha2(text, 256), 1, 16)


def query_id(query_hash: Column, id_: Column, raw: Column) -> Column:
    return F.coalesce(nz(query_hash), nz(id_), F.md5(raw))


def to_double(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def to_long(c: Column) -> Column:
    """Integer part of a number or numeric string; null if it is neither or out of range."""
    d = to_double(c)
    return F.when(F.abs(d) < 9.2e18, d.try_cast("bigint"))


def to_utc(c: Column, otherwise: Column) -> Column:
    """Wall clock in UTC of an ISO timestamp (session time zone UTC); anything else gives the fallback."""
    s = c.cast("string")
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    return F.coalesce(F.when(ok, s.try_cast("timestamp")), otherwise.cast("timestamp")).cast("timestamp_ntz")


def normalized_lines(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: list[float]) -> Column:
    """1 - cosine to a given vector in double precision; null for a zero vector, on either side."""
    norm = math.sqrt(math.fsum(float(x) * float(x) for x in b))
    given = F.array(*[F.lit(float(x)) for x in b])
    return F.lit(1.0) - F.try_divide(dot(a, given), F.sqrt(dot(a, a)) * F.lit(norm))


def terms(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
