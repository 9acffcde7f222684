"""Word and shingle hashes of whole Arrow string columns, in numpy over the UTF-8 bytes.

A hash of a word is a polynomial in its bytes modulo 2**64, taken from prefix sums and finished by a mixing step;
no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Documents are taken together up to so many bytes; a longer document is a group of its own.
GROUP_BYTES = 1 << 20
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the shingle contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and non-ASCII bytes parts words here.
PUNCT = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    PUNCT[_a:_b] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = U(1)
            _POWERS[k] = np.multiply.accumulate(p)
    out = _POWERS[0][:n], _POWERS[1][:n]
    if len(_POWERS[0]) > 4 * GROUP_BYTES:
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return out


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of whole texts of up to limit bytes; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and where each text's words begin (one more entry than texts). A-Z count as a-z.

    Long runs of bytes are worked through in steps of about GROUP_BYTES that end between words, so memory follows the
    words and not some dozens of bytes for each byte of text."""
    n, edges = len(raw), np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    parts, a = [], 0
    while a < n or not parts:
        b = n if n - a <= 2 * GROUP_BYTES else gap(raw, a + GROUP_BYTES, apart)
        inner = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b)] - a
        starts, ends, hashes = _words(raw[a:b], inner, apart)
        parts.append((starts + a, ends + a, hashes))
        a = b
    starts, ends, hashes = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def gap(raw: np.ndarray, at: int, apart: np.ndarray, step: int = 1 << 16) -> int:
    """The first place from at on that is no part of a word, or the end."""
    while at < len(raw):
        found = np.flatnonzero(apart[raw[at : at + step]])
        if len(found):
            return at + int(found[0])
        at += step
    return len(raw)


def _words(raw: np.ndarray, edges: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; a word also ends at each of the edges."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~apart[raw]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    first[edges] |= inside[1:-1][edges]
    last[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[raw]] * up[:n], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's word hashes; a shorter text is one shingle of its own kind; none without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * _COEF[k]
    found = np.sort(mix(total + U(width)))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row of a string column."""
    for a, b, raw, offsets in groups(column):
        _, _, h, at = words(raw, offsets)
        for k in range(b - a):
            yield a + k, shingles(h[at[k] : at[k + 1]], size)
