"""A minimal acyclic transducer from words to id sequences, compiled once, stored in one file and read by memory mapping.

Words that share a prefix share its path, words that end alike share the states behind, and ids are given out on the
transitions as early as the words below agree on them, so that equal rests meet in one state. A file is one array of
32-bit integers: a header, the transitions sorted by state and byte, the states' final outputs and the pool of outputs.
Lookup walks all words of a batch at once, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

MAGIC, HEAD = 0x4C455831, 8


def _agreed(a: tuple, b: tuple) -> tuple:
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    return a[:k]


class _Open:
    """A state on the path of the last word: its own ids if a word ends there, and its closed children."""

    __slots__ = ("byte", "ids", "children")

    def __init__(self, byte: int):
        self.byte, self.ids, self.children = byte, None, []


def compile_words(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The transducer of distinct words in ascending order of their bytes, each with its ids, as an array for save().

    Bounded by the number of words given; ids are below 2**31. No words give a transducer that knows none."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []

    def close(s: _Open) -> tuple[int, int, tuple]:
        """(byte, number of the equal state, ids that all words below begin with)."""
        first = s.ids if s.ids is not None else s.children[0][2] if s.children else ()
        for _, _, below in s.children:
            first = _agreed(first, below)
        n = len(first)
        shape = (None if s.ids is None else s.ids[n:], tuple((b, to, below[n:]) for b, to, below in s.children))
        if (number := known.get(shape)) is None:
            number = known[shape] = len(states)
            states.append(shape)
        return s.byte, number, first

    path, last = [_Open(0)], b""
    for word, ids in entries:
        if path[0].children or len(path) > 1 or path[0].ids is not None:
            if word <= last:
                raise ValueError("words must be distinct and in ascending order")
        n = min(len(word), len(last))
        k = 0
        while k < n and word[k] == last[k]:
            k += 1
        while len(path) > k + 1:
            done = path.pop()
            path[-1].children.append(close(done))
        path.extend(map(_Open, word[k:]))
        path[-1].ids, last = tuple(ids), word
    while len(path) > 1:
        done = path.pop()
        path[-1].children.append(close(done))
    _, root, start = close(path[0])

    pool: dict[tuple, int] = {(): 0}
    number = lambda ids: pool.setdefault(ids, len(pool))
    keys, targets, outs = [], [], []
    final = np.full(len(states), -1, np.int32)
    for k, (own, moves) in enumerate(states):
        if own is not None:
            final[k] = number(own)
        for b, to, ids in moves:
            keys.append(k * 256 + b), targets.append(to), outs.append(number(ids))
    first = number(start)
    at = np.cumsum([0, *map(len, pool)]).astype(np.int32)
    flat = np.array([i for ids in pool for i in ids], np.int32)
    head = np.array([MAGIC, len(keys), len(states), len(pool), root, first, len(flat), 0], np.int32)
    return np.concatenate((head, np.array([keys, targets, outs], np.int32).reshape(-1), final, at, flat))


class Lexicon:
    """A compiled transducer: an array, or the path of a file that holds one, which is mapped and not read."""

    def __init__(self, source: np.ndarray | str):
        raw = np.memmap(source, np.int32, "r") if isinstance(source, str) else source
        magic, moves, states, outputs, self.root, self.first, ids, _ = (int(x) for x in raw[:HEAD])
        if magic != MAGIC:
            raise ValueError("this is no lexicon")
        ends = np.cumsum([HEAD, moves, moves, moves, states, outputs + 1, ids])
        self.keys, self.targets, self.outs, self.final, self.at, self.ids = (raw[a:b] for a, b in zip(ends[:-1], ends[1:]))
        self.states = states

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """For each word its ids as little-endian 32-bit integers, or None where it is unknown."""
        n = len(words)
        if not n or not len(self.keys):
            empty = self._spell(np.array([self.first])) if self.states and self.final[self.root] >= 0 else None
            return [empty if not w else None for w in words]
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(size) - size
        state = np.full(n, -1, np.int64)
        state[size == 0] = self.root
        who, at, now = np.flatnonzero(size), 0, np.full(np.count_nonzero(size), self.root, np.int64)
        given = [(np.arange(n), np.full(n, self.first, np.int64))]
        while len(who):
            key = now * 256 + raw[begin[who] + at]
            k = np.minimum(np.searchsorted(self.keys, key.astype(np.int32)), len(self.keys) - 1)
            hit = self.keys[k] == key
            who, k = who[hit], k[hit]
            given.append((who, self.outs[k].astype(np.int64)))
            now, at = self.targets[k].astype(np.int64), at + 1
            ended = size[who] == at
            state[who[ended]] = now[ended]
            who, now = who[~ended], now[~ended]
        last = np.where(state >= 0, self.final[state], -1)
        given.append((np.arange(n), np.maximum(last, 0).astype(np.int64)))
        owner, out = (np.concatenate(x) for x in zip(*((w[o > 0], o[o > 0]) for w, o in given)))
        known = last >= 0
        keep = known[owner]
        owner, out = owner[keep], out[keep]
        by = np.argsort(owner, kind="stable")
        owner, out = owner[by], out[by]
        count = (self.at[out + 1] - self.at[out]).astype(np.int64)
        spelled = self._spell(out)
        total = np.zeros(n, np.int64)
        np.add.at(total, owner, count)
        ends = (4 * np.cumsum(total)).tolist()
        return [spelled[b - 4 * t : b] if ok else None for b, t, ok in zip(ends, total.tolist(), known.tolist())]

    def _spell(self, out: np.ndarray) -> bytes:
        """The ids of outputs, one after the other."""
        begin = self.at[out].astype(np.int64)
        count = self.at[out + 1] - begin
        ends = np.cumsum(count)
        return self.ids[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4").tobytes()
