"""Vectorised merge rounds over many words at once, for vocabularies that merge neighbouring symbols by rank.

All words lie in one flat symbol array, parted into blocks of at most BLOCK places of one word. A block keeps the least
rank of the pairs that begin in it, so a round tells each word's minimum by a segmented reduction over blocks, looks for
its places in the blocks that hold it alone, merges its leftmost non-overlapping occurrences in all words together, and
renews the blocks it touched. A merged symbol's place stays dead until half of all places are, when the array is
compacted. A round so costs its merges and one entry for each block, for words of any length.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1 << 40)
BLOCK = 32


class PairTable:
    """Pairs of symbols (below 2**20) with the symbol that each makes and its rank, in an open-addressing table.

    careful: numbers of pairs of which only the leftmost in a word may be merged in a round."""

    def __init__(self, left: list[int], right: list[int], made: list[int], rank: list[int], careful: set[int] = frozenset()):
        key = np.array(left, np.int64) * (1 << 20) + np.array(right, np.int64)
        self.made, self.rank = np.array(made, np.int64), np.append(np.array(rank, np.int64), NONE)
        self.careful = np.zeros(len(key) + 1, bool)
        self.careful[list(careful)] = True
        bits = max(4, int(len(key) * 4).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot = np.full(1 << bits, -1, np.int64)
        todo, probe = np.arange(len(key)), 0
        while len(todo):
            at = self._slot(key[todo], probe)
            put = self.slot_key[at] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put &= first
            self.slot_key[at[put]], self.slot[at[put]] = key[todo[put]], todo[put]
            todo, probe = todo[~put], probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift) + np.uint64(probe)) & self.mask).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        key = a * (1 << 20) + b
        at = self._slot(key, 0)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot[at], -1)
        todo = np.flatnonzero((held != key) & (held != -1))
        for probe in range(1, self.probes):
            if not len(todo):
                break
            at = self._slot(key[todo], probe)
            held = self.slot_key[at]
            hit = held == key[todo]
            out[todo[hit]] = self.slot[at[hit]]
            todo = todo[~hit & (held != -1)]
        return out


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Words:
    """Symbols of words in places, with each place's pair, live neighbours and word, and each block's least rank."""

    def __init__(self, sym: np.ndarray, word: np.ndarray, table: PairTable, pair: np.ndarray | None = None):
        n = len(sym)
        self.sym, self.word, self.table = sym, word, table
        place = np.arange(n)
        head = np.concatenate(([True], word[1:] != word[:-1]))
        if pair is None:
            pair = np.append(table.find(sym[:-1], sym[1:]), -1)
            pair[:-1][head[1:]] = -1
        self.pair, self.rank = pair, table.rank[pair]
        self.after = np.where(np.append(head[1:], True), -1, place + 1)
        self.before = np.where(head, -1, place - 1)
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, n))
        # blocks begin at every BLOCK-th place of a word
        begin = head | ((place - np.repeat(starts, size)) % BLOCK == 0)
        self.start = np.flatnonzero(begin)
        self.size = np.diff(np.append(self.start, n))
        self.block = np.cumsum(begin) - 1
        self.first = self.block[starts]
        self.blocks = np.diff(np.append(self.first, len(self.start)))
        self.least = np.minimum.reduceat(self.rank, self.start)
        self.alive = n

    def live(self, dead: np.ndarray) -> "_Words":
        keep = ~dead
        return _Words(self.sym[keep], self.word[keep], self.table, self.pair[keep])

    def renew(self, blocks: np.ndarray) -> None:
        at = _places(self.start[blocks], self.size[blocks])
        size = self.size[blocks]
        self.least[blocks] = np.minimum.reduceat(self.rank[at], np.cumsum(size) - size)


def merge_words(sym: np.ndarray, word: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, words) once no pair is left; word holds each symbol's word number, ascending, and every word has a symbol."""
    if not len(sym):
        return sym, word
    w = _Words(sym.astype(np.int64), word, table)
    dead = np.zeros(len(sym), bool)
    while True:
        low = np.minimum.reduceat(w.least, w.first)
        if (low == NONE).all():
            keep = ~dead
            return w.sym[keep], w.word[keep]
        of_block = np.repeat(low, w.blocks)
        hit = np.flatnonzero((w.least == of_block) & (of_block != NONE))
        at = _places(w.start[hit], w.size[hit])
        at = at[w.rank[at] == np.repeat(of_block[hit], w.size[hit])]
        # of occurrences that overlap in a run, every other one counts from the left
        begins = np.concatenate(([True], w.after[at[:-1]] != at[1:]))
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        alone = table.careful[w.pair[at]]
        if alone.any():
            first = np.concatenate(([True], w.word[at][1:] != w.word[at][:-1]))
            # where a word's pairs at the minimum are not safe together, only the leftmost is merged
            of = np.cumsum(first) - 1
            wary = np.zeros(of[-1] + 1, bool)
            wary[of[alone]] = True
            at = at[first | ~wary[of]]
        gone = w.after[at]
        w.sym[at] = table.made[w.pair[at]]
        dead[gone] = True
        w.rank[gone], w.pair[gone] = NONE, -1
        follow = w.after[gone]
        w.after[at] = follow
        inner = follow >= 0
        w.before[follow[inner]] = at[inner]
        left = w.before[at]
        fresh = np.concatenate((at, left[left >= 0]))
        right = w.after[fresh]
        ends = right < 0
        pair = table.find(w.sym[fresh], w.sym[np.where(ends, 0, right)])
        pair[ends] = -1
        w.pair[fresh], w.rank[fresh] = pair, table.rank[pair]
        touched = np.zeros(len(w.start), bool)
        touched[w.block[fresh]] = touched[w.block[gone]] = True
        w.renew(np.flatnonzero(touched))
        w.alive -= len(at)
        if 2 * w.alive < len(w.sym):
            w = w.live(dead)
            dead = np.zeros(len(w.sym), bool)
