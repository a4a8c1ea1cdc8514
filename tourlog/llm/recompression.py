"""Recompression: a run-length grammar of a string, and equal extensions read off it.

Rounds of block compression (a maximal block of one symbol becomes a symbol) and
pair compression (symbols are dealt to two sides; a left one followed by a right
one becomes a symbol) shorten the string by a constant factor each.  Equal
substrings are cut alike up to one symbol at each end of a level, so the equal
extension of two places climbs the levels, at most one symbol a level, and comes
down again.  Names are given by content, so equal symbols of a level derive
equal strings and answers are exact.
"""

from __future__ import annotations

import numpy as np

from tourlog.llm.words import mixed


class Grammar:
    """Levels over ``symbols``: numbers from 0 on, and negative ones, all distinct, which no rule takes in.

    The string has to begin and end with a negative symbol.  ``up[l][x]`` is the
    symbol of level l + 1 that holds symbol x of level l; ``first[l][y]`` and
    ``last[l][y]`` are the outermost symbols of level l in symbol y of level l + 1;
    ``block[l]`` tells block levels.
    """

    def __init__(self, symbols: np.ndarray):
        self.names = [symbols]
        self.up: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        self.block: list[bool] = []
        free = int((symbols < 0).sum())
        turn = 0
        while 2 * free - 1 < len(self.names[-1]):
            self._blocks()
            self._pairs(turn)
            turn += 1

    def _level(self, heads: np.ndarray, names: np.ndarray, block: bool) -> None:
        """A level whose symbols begin at ``heads`` of the one below."""
        n = len(self.names[-1])
        begins = np.zeros(n, np.int64)
        begins[heads] = 1
        self.up.append((np.cumsum(begins) - 1).astype(np.int32))
        self.first.append(heads.astype(np.int32))
        self.last.append((np.append(heads[1:], n) - 1).astype(np.int32))
        self.block.append(block)
        self.names.append(names)

    def _blocks(self) -> None:
        s = self.names[-1]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        heads = np.flatnonzero(new)
        if len(heads) == len(s):
            return
        size = np.diff(np.append(heads, len(s)))
        self._level(heads, _named(s[heads], size, size > 1), True)

    def _pairs(self, turn: int) -> None:
        s = self.names[-1]
        side = (mixed(s.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(np.int8)
        inside = (s[:-1] >= 0) & (s[1:] >= 0)
        left, right = side[:-1] == 0, side[1:] == 1
        pair, other = inside & left & right, inside & ~left & ~right
        if other.sum() > pair.sum():  # deal the sides the other way round
            pair = other
        if not pair.any():
            return
        begins = np.ones(len(s), bool)
        begins[1:] = ~pair
        heads = np.flatnonzero(begins)
        joined = np.append(pair, False)[heads]
        after = s[np.minimum(heads + 1, len(s) - 1)]
        self._level(heads, _named(s[heads], after, joined), False)

    def extensions(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols are equal from places x and y on (``back``: before x and y, read leftwards).

        x and y differ pairwise.
        """
        step = -1 if back else 1
        at_x, at_y = (x - 1, y - 1) if back else (x, y)
        start = at_x
        at_x, at_y = at_x.astype(np.int64), at_y.astype(np.int64)
        edge = self.last if back else self.first
        top = np.full(len(x), len(self.up))
        live = np.arange(len(x))
        # up: where a place is inside a symbol of the next level, one move brings both to its end
        for level in range(len(self.up)):
            a, b = at_x[live], at_y[live]
            inside = lambda: (edge[level][self.up[level][a]] != a) | (edge[level][self.up[level][b]] != b)  # noqa: B023, E731
            self._move(level, a, b, np.flatnonzero(inside()), step)
            at_x[live], at_y[live] = a, b
            ends = inside()  # they differ within this symbol
            top[live[ends]] = level
            live = live[~ends]
            at_x[live], at_y[live] = self.up[level][at_x[live]], self.up[level][at_y[live]]
        # down: what differs on one level has at most a symbol or two in common on the next
        for level in range(len(self.up), -1, -1):
            live = np.flatnonzero(top >= level)
            if level < len(self.up):
                came = live[top[live] > level]
                at_x[came], at_y[came] = edge[level][at_x[came]], edge[level][at_y[came]]
            while len(live):
                a, b = at_x[live], at_y[live]
                equal = self._move(level, a, b, np.arange(len(live)), step)
                at_x[live], at_y[live] = a, b
                live = live[equal]
        return np.abs(at_x - start)

    def _move(self, level: int, a: np.ndarray, b: np.ndarray, which: np.ndarray, step: int) -> np.ndarray:
        """Move those of places a, b ``which`` have equal symbols, at once over what is left of a block in both."""
        names = self.names[level]
        p, q = a[which], b[which]
        equal = names[p] == names[q]
        which, p, q = which[equal], p[equal], q[equal]
        if level < len(self.up) and self.block[level]:
            end = self.first[level] if step < 0 else self.last[level]
            far = np.minimum(np.abs(end[self.up[level][p]] - p), np.abs(end[self.up[level][q]] - q)) + 1
        else:
            far = 1
        a[which] = p + step * far
        b[which] = q + step * far
        return equal


def _named(symbol: np.ndarray, with_: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Names of the next level: symbols that are not ``joined`` keep theirs, equal pairs (symbol, with_) get one new name."""
    names = symbol.copy()
    a, b = symbol[joined], with_[joined]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    number = np.zeros(len(order), np.int64)
    number[order[1:]] = np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    names[joined] = symbol.max() + 1 + number
    return names
