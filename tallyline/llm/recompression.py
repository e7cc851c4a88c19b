"""Run-length grammars by recompression, and longest common extensions in them.

A string of numbers is shortened by turns. A block step replaces every stretch of one repeated symbol by a symbol of its
own for that symbol and length. A pair step deals the symbols into left and right ones and replaces every left symbol that
a right one follows, with it, by a symbol of its own. Equal substrings are replaced alike but for a symbol or two at their
ends, so two positions are compared by climbing while the symbols ahead agree, stepping over whole symbols, and by going
down again to the place where they differ: a constant number of steps on each of O(log n) levels. All queries of a string
take their steps together in numpy; nothing is sorted by suffix.
"""

from __future__ import annotations

import numpy as np

SIDES = 4  # ways of dealing out symbols that are tried for each pair step
QUERIES = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Level:
    """One level of a grammar: symbols, their lengths in the string, and where each one's parent begins above."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = symbols, lengths
        self.parent = self.first = self.stretch = np.zeros(0, np.int64)

    def grouped(self, heads: np.ndarray) -> None:
        """Set the parents, which begin at the symbols where `heads` is true."""
        self.parent = np.cumsum(heads) - 1
        self.first = np.flatnonzero(heads)
        # how often the symbol at a place comes again from there on, itself included
        ends = np.append(np.flatnonzero(np.diff(self.symbols)), len(self.symbols) - 1)
        self.stretch = ends[np.searchsorted(ends, np.arange(len(self.symbols)))] - np.arange(len(self.symbols)) + 1

    def mirrored(self) -> Level:
        """The same level read from its end."""
        back = Level(self.symbols[::-1], self.lengths[::-1])
        if len(self.parent):
            parent = self.parent[::-1]
            back.grouped(np.append(True, parent[1:] != parent[:-1]))
        return back


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers 0.. for pairs of numbers, equal for equal pairs."""
    wide = int(b.max(initial=0)) + 1
    return np.unique(a * wide + b, return_inverse=True)[1]


def _block_step(level: Level) -> Level | None:
    s = level.symbols
    heads = np.append(True, s[1:] != s[:-1])
    if heads.all():
        return None
    level.grouped(heads)
    count = np.diff(np.append(level.first, len(s)))
    return Level(_numbered(s[level.first], count), np.add.reduceat(level.lengths, level.first))


def _pair_step(level: Level, turn: int) -> Level:
    s = level.symbols
    best: np.ndarray | None = None
    for seed in range(SIDES):
        x = (s.astype(np.uint64) + np.uint64(turn * SIDES + seed + 1)) * _MIX
        right = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1
        second = np.append(False, ~right[:-1] & right[1:])
        if best is None or second.sum() > best.sum():
            best = second
    assert best is not None
    level.grouped(~best)
    after = np.where(np.append(best[1:], False), np.append(s[1:], 0) + 1, 0)  # the paired symbol + 1, or 0
    return Level(_numbered(s[level.first], after[level.first]), np.add.reduceat(level.lengths, level.first))


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels of a string of numbers of 0 or more, from the string up to a few symbols."""
    levels = [Level(np.unique(symbols, return_inverse=True)[1], np.ones(len(symbols), np.int64))]
    turn = 0
    while len(levels[-1].symbols) > 3 and turn < 400:
        up = _block_step(levels[-1])
        if up is not None:
            levels.append(up)
        if len(levels[-1].symbols) > 3:
            levels.append(_pair_step(levels[-1], turn))
        turn += 1
    return levels


def _extend(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on agree. Each query must meet a difference before either end."""
    matched = np.zeros(len(i), np.int64)
    i, j, top = i.copy(), j.copy(), len(levels) - 1

    def step(h: int, at: np.ndarray) -> np.ndarray:
        """Step over the symbols ahead of queries `at` on level h, where they agree; returns which agreed."""
        level = levels[h]
        same = level.symbols[i[at]] == level.symbols[j[at]]
        go = at[same]
        a, b = i[go], j[go]
        n = np.minimum(level.stretch[a], level.stretch[b]) if h < top else np.ones(len(go), np.int64)
        matched[go] += n * level.lengths[a]
        i[go] += n
        j[go] += n
        return same

    stopped: list[np.ndarray] = []  # queries that leave the way up on each level, because symbols there differ
    going = np.arange(len(i))
    for h in range(top):
        level, ready, lost = levels[h], [], []
        while len(going):
            up = (level.first[level.parent[i[going]]] == i[going]) & (level.first[level.parent[j[going]]] == j[going])
            ready.append(going[up])
            going = going[~up]
            same = step(h, going)
            lost.append(going[~same])
            going = going[same]
        stopped.append(np.concatenate(lost) if lost else going)
        going = np.concatenate(ready) if ready else going
        i[going], j[going] = level.parent[i[going]], level.parent[j[going]]
    for h in range(top, -1, -1):
        if h < top:  # those from above go down to the first symbols below
            i[going], j[going] = levels[h].first[i[going]], levels[h].first[j[going]]
            ahead = np.append(going, stopped[h])
        else:
            ahead = going
        going = ahead
        while len(ahead):
            ahead = ahead[step(h, ahead)]
    return matched


class Extensions:
    """Longest common extensions, to the right and to the left, between places of a string of numbers."""

    def __init__(self, symbols: np.ndarray):
        # ends of their own, so that no query runs over; their like occurs nowhere
        high = int(symbols.max(initial=0))
        self.n = len(symbols)
        self.levels = grammar(np.concatenate(([high + 1], symbols, [high + 2])))
        self.back = [level.mirrored() for level in self.levels]

    def _all(self, levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [_extend(levels, i[k: k + QUERIES], j[k: k + QUERIES]) for k in range(0, len(i), QUERIES)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of what begins at i and what begins at j, i unlike j."""
        return self._all(self.levels, i + 1, j + 1)

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common suffix of what ends before i and what ends before j, i unlike j."""
        return self._all(self.back, self.n + 1 - i, self.n + 1 - j)
