"""Byte automata: regular expressions to one minimal deterministic automaton.

Supported syntax: literals, ``.``, escapes (``\\d \\w \\s \\n \\t`` and escaped
punctuation), classes with ranges and negation, groups, ``|``, and the greedy
quantifiers ``? * + {n} {n,} {n,m}``.
"""

from __future__ import annotations

from array import array
from collections import deque
from dataclasses import dataclass

import numpy as np

WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
#: Bytes of keys and tokens: where a rule asks for it, a match must not follow one of these.
TOKEN = WORD | frozenset(b"+/.-")
_SETS = {"d": frozenset(b"0123456789"), "w": WORD, "s": frozenset(b" \t\n\f\r"), "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}
_ALL = frozenset(range(256))


class _Parser:
    """Recursive descent; builds fragments of a nondeterministic automaton with empty moves."""

    def __init__(self, pattern: str, ignore_case: bool, nfa: _Nfa):
        self.p, self.i, self.fold, self.nfa = pattern, 0, ignore_case, nfa

    def parse(self) -> tuple[int, int]:
        out = self.choice()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return out

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def choice(self) -> tuple[int, int]:
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        if len(options) == 1:
            return options[0]
        s, e = self.nfa.state(), self.nfa.state()
        for a, b in options:
            self.nfa.empty[s].append(a)
            self.nfa.empty[b].append(e)
        return s, e

    def sequence(self) -> tuple[int, int]:
        s = e = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            at = self.i
            a, b = self.atom()
            until = self.i
            low, high = self.quantifier()
            if (low, high) != (1, 1):
                a, b = self.repeat(at, until, low, high)
            self.nfa.empty[e].append(a)
            e = b
        return s, e

    def repeat(self, at: int, until: int, low: int, high: int | None) -> tuple[int, int]:
        after = self.i

        def copy() -> tuple[int, int]:
            self.i = at
            part = self.atom()
            assert self.i == until
            return part

        s = e = self.nfa.state()
        for _ in range(low):
            a, b = copy()
            self.nfa.empty[e].append(a)
            e = b
        if high is None:
            a, b = copy()
            end = self.nfa.state()
            self.nfa.empty[e] += [a, end]
            self.nfa.empty[b] += [a, end]
            e = end
        else:
            end = self.nfa.state()
            for _ in range(high - low):
                a, b = copy()
                self.nfa.empty[e] += [a, end]
                e = b
            self.nfa.empty[e].append(end)
            e = end
        self.i = after
        return s, e

    def quantifier(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in ("?", "*", "+"):
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.p.index("}", self.i)
            low, comma, high = self.p[self.i + 1 : end].partition(",")
            self.i = end + 1
            return int(low), int(high) if high else (None if comma else int(low))
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            part = self.choice()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return part
        if c == "[":
            return self.step(self.bracket())
        if c == ".":
            return self.step(_ALL - {10})
        if c == "\\":
            return self.step(self.escape())
        raw = c.encode()
        if len(raw) == 1:
            return self.step(frozenset(raw))
        s = e = self.nfa.state()
        for byte in raw:
            a, b = self.step(frozenset([byte]))
            self.nfa.empty[e].append(a)
            e = b
        return s, e

    def escape(self) -> frozenset[int]:
        c = self.p[self.i]
        self.i += 1
        return _SETS.get(c) or frozenset(c.encode())

    def bracket(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                found |= self.escape()
            elif self.peek() == "-" and self.p[self.i + 1] != "]":
                found |= set(range(ord(c), ord(self.p[self.i + 1]) + 1))
                self.i += 2
            else:
                found |= set(c.encode())
        self.i += 1
        return frozenset(_ALL - found if negated else found)

    def step(self, on: frozenset[int]) -> tuple[int, int]:
        if self.fold:
            on = on | frozenset(ord(chr(b).swapcase()) for b in on if b < 128 and chr(b).isalpha())
        s, e = self.nfa.state(), self.nfa.state()
        self.nfa.moves[s] = (on, e)
        return s, e


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: dict[int, tuple[frozenset[int], int]] = {}

    def state(self) -> int:
        self.empty.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for t in self.empty[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Rule:
    """A named pattern.

    ``left``: the match must not follow a byte of TOKEN.  ``right``: it must end with
    a word byte that no other word byte follows.
    """

    name: str
    pattern: str
    ignore_case: bool = False
    left: bool = True
    right: bool = True

    def regex(self) -> str:
        """The same rule for Python's re."""
        left = r"(?<![0-9A-Za-z_+/.\-])" if self.left else ""
        return ("(?i)" if self.ignore_case else "") + left + f"(?:{self.pattern})" + (r"\b" if self.right else "")

    def re2(self) -> str:
        """The same rule for RE2, with the match as group 1."""
        left = r"(?:^|[^0-9A-Za-z_+/.\-])" if self.left else ""
        return ("(?i)" if self.ignore_case else "") + left + f"({self.pattern})" + (r"\b" if self.right else "")


@dataclass(frozen=True)
class Dfa:
    """``next[state, kind[byte]]``; state 0 starts; ``accept`` has a bit for each rule."""

    next: np.ndarray
    kind: np.ndarray
    accept: np.ndarray

    @property
    def rows(self) -> list[array]:
        """For each state its 256 next states and, last, its rules; for a scan of single texts."""
        full = self.next[:, self.kind]
        return [array("Q", [*map(int, full[s]), int(self.accept[s])]) for s in range(len(full))]


def compile_rules(rules: list[Rule], anchored: bool = False) -> Dfa:
    """One minimal automaton for all rules.

    Not anchored, it is in an accepting state after exactly the bytes at which a
    match of a rule ends; a match may start at any byte, or, with ``left``, at any
    that follows a byte outside TOKEN.
    """
    nfa = _Nfa()
    ends: dict[int, int] = {}
    starts: list[tuple[int, bool]] = []
    for k, rule in enumerate(rules):
        s, e = _Parser(rule.pattern, rule.ignore_case, nfa).parse()
        ends[e] = k
        starts.append((s, rule.left))
    # bytes that no move tells apart are of one kind
    sets = sorted({on for on, _ in nfa.moves.values()} | {TOKEN}, key=sorted)
    codes: dict[tuple, int] = {}
    kind = np.array([codes.setdefault(tuple(b in s for s in sets), len(codes)) for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(codes))]
    all_starts = nfa.closure([s for s, _ in starts])
    after_token = frozenset() if anchored else nfa.closure([s for s, left in starts if not left])
    after_other = frozenset() if anchored else all_starts
    # subset construction
    number: dict[frozenset[int], int] = {all_starts: 0}
    todo, table = deque([all_starts]), []
    while todo:
        subset = todo.popleft()
        row = []
        for byte in sample:
            moved = [nfa.moves[s][1] for s in subset if s in nfa.moves and byte in nfa.moves[s][0]]
            target = nfa.closure(moved) | (after_token if byte in TOKEN else after_other)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        table.append(row)
    accept = np.zeros(len(number), np.uint64)
    for subset, s in number.items():
        for e, k in ends.items():
            if e in subset:
                accept[s] |= np.uint64(1 << k)
    return minimise(Dfa(np.array(table, np.int64), kind, accept))


def minimise(dfa: Dfa) -> Dfa:
    """Moore's refinement: states are merged unless some continuation tells them apart."""
    _, part = np.unique(dfa.accept, return_inverse=True)
    count = part.max() + 1
    while True:
        _, part = np.unique(np.concatenate([part[:, None], part[dfa.next]], axis=1), axis=0, return_inverse=True)
        part = part.reshape(-1)
        if part.max() + 1 == count:
            break
        count = part.max() + 1
    # number the parts by first occurrence, so that the start is 0
    _, first = np.unique(part, return_index=True)
    order = np.argsort(first)
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    keep = first[order]
    return Dfa(rank[part[dfa.next[keep]]].astype(np.int32), dfa.kind, dfa.accept[keep])
