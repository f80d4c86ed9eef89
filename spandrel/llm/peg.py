"""Packrat parsing-expression grammars.

A grammar is text: ``Rule <- expression`` lines with ``|`` for ordered choice, sequences,
``* + ?``, the predicates ``& !``, groups, ``'literal'`` and ``/regular expression/`` terminals.
Terminals swallow the white space and comments that follow (the grammar's spacing); ``~/.../``
swallows nothing. The text must be consumed in full; otherwise the furthest position any terminal
failed at is reported.

Results are memoised per position for the rules that recursion goes through: at least one of every
cycle of rules, so between two memoised rules there is a fixed amount of work and parsing takes
linear time. What such a rule remembers is forgotten at every statement of the start rule, from
where no way leads back, and when it grows beyond a bound, which costs time but changes nothing.
Each choice looks at the next character first and passes over what can't begin with it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from re import _parser as sre  # type: ignore[attr-defined]
from re import _constants as op  # type: ignore[attr-defined]

import regex

_DSL = re.compile(r"\s*(?:(?P<rule>[A-Z]\w*)\s*<-|(?P<name>[A-Z]\w*)|'(?P<lit>[^']+)'|(?P<raw>~?)/(?P<rx>(?:[^/\\]|\\.)*)/|(?P<op>[|()*+?&!]))")
#: Positions a rule remembers at most; some 100 bytes each.
MEMO = 60_000

_ASCII = [chr(i) for i in range(128)]
_OTHER = "\x80"  # stands for all that isn't ASCII
_EVERY = frozenset(_ASCII) | {_OTHER}


def _class_members(items: list) -> frozenset:
    negate, found = False, set()
    for kind, value in items:
        if kind is op.NEGATE:
            negate = True
        elif kind is op.LITERAL:
            found.add(chr(value) if value < 128 else _OTHER)
        elif kind is op.RANGE:
            found |= {c for c in _ASCII if value[0] <= ord(c) <= value[1]}
            if value[1] > 127:
                found.add(_OTHER)
        else:
            one = re.compile({op.CATEGORY_DIGIT: r"\d", op.CATEGORY_NOT_DIGIT: r"\D", op.CATEGORY_SPACE: r"\s", op.CATEGORY_NOT_SPACE: r"\S", op.CATEGORY_WORD: r"\w", op.CATEGORY_NOT_WORD: r"\W"}[value])
            found |= {c for c in _ASCII if one.match(c)} | {_OTHER}
    return (_EVERY - (found - {_OTHER})) if negate else frozenset(found)


def _begin(parsed) -> tuple[frozenset, bool]:
    """(characters a match may begin with, whether it may be empty) of a parsed pattern."""
    out: frozenset = frozenset()
    for kind, value in parsed:
        if kind is op.LITERAL:
            first, empty = frozenset(chr(value) if value < 128 else _OTHER), False
        elif kind is op.NOT_LITERAL:
            first, empty = _EVERY - {chr(value)}, False
        elif kind is op.IN:
            first, empty = _class_members(value), False
        elif kind is op.BRANCH:
            ways = [_begin(x) for x in value[1]]
            first, empty = frozenset().union(*(w[0] for w in ways)), any(w[1] for w in ways)
        elif kind is op.SUBPATTERN and not value[1] & re.I:
            first, empty = _begin(value[3])
        elif kind is op.ATOMIC_GROUP:
            first, empty = _begin(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            first, empty = _begin(value[2])
            empty = empty or value[0] == 0
        elif kind in (op.ASSERT, op.ASSERT_NOT, op.AT):
            first, empty = frozenset(), True
        else:
            first, empty = _EVERY, True
        out |= first
        if not empty:
            return out, False
    return out, True


class Grammar:
    def __init__(self, text: str, spacing: str, start: str = "Start") -> None:
        self._spacing = spacing
        self._far = [0]
        self._text = [""]
        self._memos: list[dict[int, int]] = []
        tokens = []
        at = 0
        while text[at:].strip():
            m = _DSL.match(text, at)
            if not m:
                raise ValueError(f"grammar text at {text[at:at + 40]!r}")
            tokens.append(m)
            at = m.end()
        names = [m["rule"] for m in tokens if m["rule"]]
        if len(set(names)) != len(names):
            raise ValueError("a rule is defined twice")
        self._tokens, self._at = tokens, 0
        self._trees: dict[str, tuple] = {}
        while self._at < len(tokens):
            name = tokens[self._at]["rule"]
            self._at += 1
            self._trees[name] = self._choice()
        self._firsts: dict[str, tuple[frozenset, bool]] = {n: (frozenset(), False) for n in names}
        self._find_firsts()
        self._gates = self._cut_cycles(start)
        self._cells: dict[str, list] = {n: [None] for n in self._gates}
        self._made: dict[str, Callable[[int], int]] = {}
        for n in self._gates:
            self._cells[n][0] = self._make(self._trees[n], n == start)
        self._skip = regex.compile(spacing)
        self._start = self._rule(start)

    # -- reading the grammar's text
    def _peek(self):
        return self._tokens[self._at] if self._at < len(self._tokens) else None

    def _choice(self) -> tuple:
        options = [self._sequence()]
        while (t := self._peek()) and t["op"] == "|":
            self._at += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def _sequence(self) -> tuple:
        parts = []
        while (t := self._peek()) and not t["rule"] and t["op"] not in ("|", ")"):
            parts.append(self._prefix())
        return parts[0] if len(parts) == 1 else ("sequence", parts)

    def _prefix(self) -> tuple:
        t = self._peek()
        if t["op"] in ("&", "!"):
            self._at += 1
            return ("look", self._suffix(), t["op"] == "&")
        return self._suffix()

    def _suffix(self) -> tuple:
        f = self._primary()
        while (t := self._peek()) and t["op"] in ("*", "+", "?"):
            self._at += 1
            f = ("repeat", f, t["op"])
        return f

    def _primary(self) -> tuple:
        t = self._peek()
        self._at += 1
        if t["op"] == "(":
            f = self._choice()
            if self._peek()["op"] != ")":
                raise ValueError("missing )")
            self._at += 1
            return f
        if t["name"]:
            return ("rule", t["name"])
        if t["lit"]:
            lit = t["lit"]
            return ("terminal", re.escape(lit) + (r"\b" if lit[-1].isalnum() or lit[-1] == "_" else ""), True)
        if t["rx"] is not None:
            return ("terminal", t["rx"].replace(r"\/", "/"), not t["raw"])
        raise ValueError(f"unexpected {t.group()!r}")

    # -- what it may begin with, and where it recurs
    def _first(self, tree: tuple) -> tuple[frozenset, bool]:
        kind = tree[0]
        if kind == "terminal":
            try:
                first, empty = _begin(sre.parse(tree[1]))
            except re.error:
                return _EVERY, True
            return (_EVERY, True) if empty and (tree[2] or first) else (first, empty)
        if kind == "rule":
            return self._firsts[tree[1]]
        if kind == "choice":
            ways = [self._first(x) for x in tree[1]]
            return frozenset().union(*(w[0] for w in ways)), any(w[1] for w in ways)
        if kind == "repeat":
            first, empty = self._first(tree[1])
            return first, empty or tree[2] != "+"
        if kind == "look":  # not to match what always matches: never
            return frozenset(), tree[2] or tree[1] != ("terminal", "(?:)", False)
        out: frozenset = frozenset()
        for part in tree[1]:
            first, empty = self._first(part)
            out |= first
            if not empty:
                return out, False
        return out, True

    def _find_firsts(self) -> None:
        changed = True
        while changed:
            changed = False
            for n, tree in self._trees.items():
                now = self._first(tree)
                if now != self._firsts[n]:
                    self._firsts[n], changed = now, True

    def _uses(self, tree: tuple) -> list[str]:
        if tree[0] == "rule":
            return [tree[1]]
        if tree[0] in ("choice", "sequence"):
            return [n for x in tree[1] for n in self._uses(x)]
        return self._uses(tree[1]) if tree[0] in ("repeat", "look") else []

    def _cut_cycles(self, start: str) -> list[str]:
        """Rules such that every cycle of rules has one of them: those a depth-first search meets
        again while it is below them."""
        gates, state = [start], {}

        def visit(n: str) -> None:
            state[n] = 1
            for m in self._uses(self._trees[n]):
                if m not in state:
                    visit(m)
                elif state[m] == 1 and m not in gates:
                    gates.append(m)
            state[n] = 2

        visit(start)
        return gates

    # -- making functions of it
    def _make(self, tree: tuple, start: bool = False) -> Callable[[int], int]:
        kind = tree[0]
        if kind == "terminal":
            return self._terminal(tree[1], tree[2])
        if kind == "rule":
            return self._rule(tree[1])
        if kind == "choice":
            return self._one_of(tree[1])
        if kind == "repeat":
            return self._repeat(tree[1], tree[2], start)
        if kind == "look":
            return self._look(self._make(tree[1]), tree[2])
        parts = [x for x in tree[1] if not (x[0] == "repeat" and x[2] != "+" and self._first(x[1]) == (frozenset(), False))]
        made = [self._make(x, start) for x in parts]
        return made[0] if len(made) == 1 else self._in_turn(made)

    def _rule(self, name: str) -> Callable[[int], int]:
        made = self._made.get(name)
        if made is None:
            made = self._made[name] = self._gate(self._cells[name]) if name in self._cells else self._make(self._trees[name])
        return made

    def _gate(self, cell: list) -> Callable[[int], int]:
        memo: dict[int, int] = {}
        self._memos.append(memo)

        def gate(p: int) -> int:
            q = memo.get(p)
            if q is None:
                if len(memo) > MEMO:
                    memo.clear()
                memo[p] = -1  # a left-recursive call fails
                q = memo[p] = cell[0](p)
            return q

        return gate

    @staticmethod
    def _in_turn(parts: list) -> Callable[[int], int]:
        if len(parts) == 2:
            a, b = parts

            def pair(p: int) -> int:
                p = a(p)
                return b(p) if p >= 0 else -1

            return pair
        if len(parts) == 3:
            a, b, c = parts

            def three(p: int) -> int:
                p = a(p)
                if p < 0:
                    return -1
                p = b(p)
                return c(p) if p >= 0 else -1

            return three
        parts = tuple(parts)

        def sequence(p: int) -> int:
            for f in parts:
                p = f(p)
                if p < 0:
                    return -1
            return p

        return sequence

    def _one_of(self, trees: list) -> Callable[[int], int]:
        ways = [(self._make(t), *self._first(t)) for t in trees]
        table = {c: tuple(f for f, first, empty in ways if empty or c in first) for c in _EVERY}
        table[""] = tuple(f for f, _, empty in ways if empty)
        other = table[_OTHER]
        text, far = self._text, self._far

        def choice(p: int) -> int:
            for f in table.get(text[0][p : p + 1], other):
                q = f(p)
                if q >= 0:
                    return q
            if p > far[0]:
                far[0] = p
            return -1

        return choice

    def _look(self, f: Callable[[int], int], want: bool) -> Callable[[int], int]:
        far = self._far

        def look(p: int) -> int:
            kept = far[0]
            q = f(p)
            far[0] = kept
            return p if (q >= 0) == want else -1

        return look

    def _repeat(self, tree: tuple, how: str, start: bool) -> Callable[[int], int]:
        f, (first, empty) = self._make(tree), self._first(tree)
        text = self._text
        begins = first if not empty and _OTHER not in first else None  # what a first look can rule out
        if how == "?":
            if begins is None:
                def option(p: int) -> int:
                    q = f(p)
                    return q if q >= 0 else p
            else:
                def option(p: int) -> int:
                    if text[0][p : p + 1] in begins:
                        q = f(p)
                        return q if q >= 0 else p
                    return p
            return option
        least = -1 if how == "+" else 0
        memos = self._memos if start else ()

        def many(p: int) -> int:
            if begins is not None and text[0][p : p + 1] not in begins:
                return p if least == 0 else f(p)
            q = f(p)
            if q < 0:
                return p if least == 0 else -1
            while q > p:
                for m in memos:
                    m.clear()
                p = q
                if begins is not None and text[0][p : p + 1] not in begins:
                    return p
                q = f(p)
            return p

        return many

    def _terminal(self, pattern: str, spaced: bool) -> Callable[[int], int]:
        pattern = f"(?:{pattern})" + (self._spacing if spaced else "")
        try:
            match = re.compile(pattern).match
        except re.error:
            match = regex.compile(pattern).match
        text, far = self._text, self._far

        def terminal(p: int) -> int:
            m = match(text[0], p)
            if m:
                return m.end()
            if p > far[0]:
                far[0] = p
            return -1

        return terminal

    # -- parsing
    def furthest(self, text: str) -> int | None:
        """None if the whole text is a sentence of the grammar, else the furthest failure."""
        self._text[0], self._far[0] = text, 0
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(1_000_000)
        try:
            p = self._skip.match(text, 0).end()
            q = self._start(p)
        finally:
            sys.setrecursionlimit(limit)
            for m in self._memos:
                m.clear()
            self._text[0] = ""
        return None if q == len(text) else max(self._far[0], q, p)
