"""Patterns compiled into one deterministic automaton over bytes.

Patterns are regular expressions of literals, ``\\xHH`` and ``\\`` escapes,
classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{n}``, ``{n,}``, ``{n,m}``, over
ASCII.  Subset construction follows, for every rule, the leftmost match and its
longest end; the product of all rules is minimised into one table of
transitions.  One pass over the bytes of a text then gives the ends of the
leftmost, non-overlapping matches of every rule; a backward automaton of the
rule finds where each began.

A rule is refused if telling its match would need bytes to be read again: an
end that the automaton passes by and has to come back to, or two starts of
which the later one matches first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ASCII = frozenset(range(128))


@dataclass(frozen=True)
class Rule:
    """``head`` then ``tail``; a match counts if its tail has ``least`` characters.

    Matches that do not count still use up their text.  ``fold`` lets letters of
    the pattern stand for either case.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 0
    fold: bool = False


class Nfa:
    """Thompson's automaton: ``moves[state]`` lists (set of bytes, next state), ``free[state]`` moves without a byte."""

    def __init__(self, pattern: str, fold: bool = False):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.text, self.at, self.fold = pattern, 0, fold
        self.start, self.accept = self._either()
        if self.at < len(pattern):
            raise ValueError(f"{pattern!r}: unexpected {pattern[self.at]!r} at {self.at}")

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self) -> tuple[int, int]:
        first, last = self._state(), self._state()
        while True:
            a, b = self._sequence()
            self.free[first].append(a)
            self.free[b].append(last)
            if self._peek() != "|":
                return first, last
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        first = last = self._state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            part = self._atom()
            least, most = self._times()
            end = self.at
            for k in range(least if most is None else most):
                if k:  # a copy of the part
                    self.at = begin
                    part = self._atom()
                if k >= least:
                    self.free[last].append(part[1])
                self.free[last].append(part[0])
                last = part[1]
            if most is None:
                if not least:
                    self.free[last].append(part[0])
                    self.free[part[1]].append(last)
                else:
                    self.free[part[1]].append(part[0])
            self.at = end
        return first, last

    def _times(self) -> tuple[int, int | None]:
        sign = self._peek()
        if sign in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        if sign != "{":
            return 1, 1
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at + 1 : end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 1
            found = self._either()
            if self._peek() != ")":
                raise ValueError(f"{self.text!r}: missing )")
            self.at += 1
            return found
        first, last = self._state(), self._state()
        self.moves[first].append((self._members(), last))
        return first, last

    def _members(self) -> frozenset[int]:
        if self._peek() != "[":
            return self._cased({self._char()})
        self.at += 1
        other = self._peek() == "^"
        self.at += other
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._char()
            found |= set(range(low, high + 1))
        self.at += 1
        cased = self._cased(found)
        return ASCII - cased if other else cased

    def _char(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if not c or ord(c) > 127:
            raise ValueError(f"{self.text!r}: no ASCII character at {self.at - 1}")
        return ord(c)

    def _cased(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(x) for c in found for x in (chr(c).lower(), chr(c).upper())}
        return frozenset(found)

    def closed(self, states) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({to for s in states for members, to in self.moves[s] if byte in members})

    def reversed(self) -> Nfa:
        """The automaton of the same words read backwards."""
        back = Nfa.__new__(Nfa)
        back.moves = [[] for _ in self.moves]
        back.free = [[] for _ in self.free]
        for s, moves in enumerate(self.moves):
            for members, to in moves:
                back.moves[to].append((members, s))
        for s, free in enumerate(self.free):
            for to in free:
                back.free[to].append(s)
        back.start, back.accept = self.accept, self.start
        return back


class Walker:
    """An anchored automaton whose states are made deterministic as they are met."""

    def __init__(self, nfa: Nfa):
        self.nfa = nfa
        self.numbers: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.next: dict[tuple[int, int], int] = {}
        self._number(nfa.closed([nfa.start]))

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
        return self.numbers[states]

    def farthest(self, data: bytes, places: range) -> int | None:
        """The last of ``places`` (read in turn) at which a word has ended, if any."""
        state, found = 0, None
        for i in places:
            key = state, data[i]
            if key not in self.next:
                self.next[key] = self._number(self.nfa.move(self.sets[state], data[i]))
            state = self.next[key]
            if not self.sets[state]:
                break
            if self.nfa.accept in self.sets[state]:
                found = i
        return found


@dataclass(frozen=True)
class _Scan:
    """Where one rule stands: sets of states by start, the earliest first; ``held`` once the first of them matched."""

    groups: tuple[frozenset[int], ...] = ()
    held: bool = False


def _step(rule: Rule, nfa: Nfa, scan: _Scan, byte: int) -> tuple[_Scan, bool]:
    """The next scan, and whether a match ended before ``byte``."""
    if scan.held:
        kept = nfa.move(scan.groups[0], byte)
        if kept:
            if nfa.accept not in kept:
                raise ValueError(f"rule {rule.kind}: a match would have to be taken back")
            return _Scan((kept,), True), False
        return _step(rule, nfa, _Scan(), byte)[0], True
    groups, seen = [], set()
    for g in (*scan.groups, nfa.closed([nfa.start])):
        # a later start in the same state has the same end and never wins
        new = nfa.move(g, byte) - seen
        seen |= new
        if nfa.accept in new:
            if groups:
                raise ValueError(f"rule {rule.kind}: a later start would match first")
            return _Scan((new,), True), False
        if any(nfa.moves[s] for s in new):
            groups.append(new)
    return _Scan(tuple(groups)), False


def _scanner(rule: Rule, nfa: Nfa, shown: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subset construction of one rule: next states and ends by (state, code), and the states that hold a match."""
    numbers, todo, to, ended = {_Scan(): 0}, [_Scan()], [], []
    while len(to) < len(todo):
        steps = [_step(rule, nfa, todo[len(to)], byte) for byte in shown]
        for scan, _ in steps:
            if scan not in numbers:
                numbers[scan] = len(todo)
                todo.append(scan)
        to.append([numbers[scan] for scan, _ in steps])
        ended.append([end for _, end in steps])
    return np.array(to, np.int64), np.array(ended, np.int64), np.array([s.held for s in todo], np.int64)


def _product(single: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states that all rules can be in together; bit k of ends and holds stands for rule k."""
    radix = np.cumprod([1, *(len(to) for to, _, _ in single[:-1])])
    if float(radix[-1]) * len(single[-1][0]) > 2.0**62:
        raise ValueError("too many rules for one automaton")
    known = np.zeros(1, np.int64)
    frontier = known
    while len(frontier):
        reached = sum(to[frontier // r % len(to)] * r for (to, _, _), r in zip(single, radix.tolist()))
        frontier = np.setdiff1d(reached, known)
        known = np.union1d(known, frontier)
    place = lambda k: known // int(radix[k]) % len(single[k][0])
    reached = sum(single[k][0][place(k)] * int(radix[k]) for k in range(len(single)))
    ended = sum(single[k][1][place(k)] << k for k in range(len(single)))
    held = sum(single[k][2][place(k)] << k for k in range(len(single)))
    return np.searchsorted(known, reached), ended, held


class Automaton:
    """All ``rules`` in one table.

    ``table[state][code]`` is the next state for the class of a byte; numbers from
    ``len(table)`` on stand for a row of ``events``: the next state, and the rules of
    which a match ended before this byte.  ``last[state]`` lists the rules of which
    a match ends with the text.
    """

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        nfas = [Nfa(r.head + r.tail, r.fold) for r in rules]
        for r, n in zip(rules, nfas):
            if n.accept in n.closed([n.start]):
                raise ValueError(f"rule {r.kind} matches the empty text")
        self.codes, shown = _classes(nfas)
        single = [_scanner(r, n, shown) for r, n in zip(rules, nfas)]
        to, ended, held = _product(single)
        self._minimised(to, ended, held)
        self.backward = [Walker(n.reversed()) for n in nfas]
        self.heads = [Walker(Nfa(r.head, r.fold)) if r.tail and r.head else None for r in rules]

    def _minimised(self, to: np.ndarray, ended: np.ndarray, held: np.ndarray) -> None:
        """Merge states that no text tells apart (partition refinement)."""
        block = np.unique(np.column_stack([ended, held]), axis=0, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([block, block[to]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = {int(block[0]): 0}  # the start is state 0
        for b in block.tolist():
            order.setdefault(b, len(order))
        shown = {b: int(np.argmax(block == b)) for b in order}
        n, events = len(order), {}
        table = []
        for b in order:
            row = []
            for c in range(to.shape[1]):
                nxt, ends = order[int(block[to[shown[b], c]])], int(ended[shown[b], c])
                row.append(nxt if not ends else n + events.setdefault((nxt, ends), len(events)))
            table.append(row)
        listed = lambda bits: tuple(k for k in range(len(self.rules)) if bits >> k & 1)
        self.table, self.events = table, [(s, listed(bits)) for s, bits in events]
        self.last = [listed(int(held[shown[b]])) for b in order]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of every match, in one pass over the bytes."""
        table, n, state, found = self.table, len(self.table), 0, []
        for i, c in enumerate(data.translate(self.codes)):
            state = table[state][c]
            if state >= n:
                state, ended = self.events[state - n]
                found += [(k, i) for k in ended]
        return found + [(k, len(data)) for k in self.last[state]]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of the matches that count, sorted."""
        after, found = [0] * len(self.rules), []
        for k, end in self.ends(data):
            start = self.backward[k].farthest(data, range(end - 1, after[k] - 1, -1))
            after[k] = end
            rule, begin = self.rules[k], start
            if self.heads[k]:
                begin = self.heads[k].farthest(data, range(start, end)) + 1
            if end - begin >= rule.least:
                found.append((start, k, end))
        return sorted(found)


def _classes(nfas: list[Nfa]) -> tuple[bytes, list[int]]:
    """Bytes that no rule tells apart share a code; one byte of each code."""
    sets = list({members for n in nfas for moves in n.moves for members, _ in moves})
    codes, seen, shown = bytearray(256), {}, []
    for byte in range(256):
        key = tuple(byte in s for s in sets)
        if key not in seen:
            seen[key] = len(shown)
            shown.append(byte)
        codes[byte] = seen[key]
    return bytes(codes), shown
