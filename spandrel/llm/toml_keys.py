"""Keys a TOML text defines twice: what its grammar can't say."""

from __future__ import annotations

import re
import sys

_GAP = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)*")
_PART = re.compile(r"[ \t]*(?:(?P<bare>[A-Za-z0-9_-]+)|\"(?P<basic>(?:[^\"\\]|\\.)*)\"|'(?P<literal>[^']*)')[ \t]*")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))")
_PLAIN = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r"}
_LONG = re.compile(r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"{3,5}|' + r"'''(?:[^']|'(?!''))*'{3,5}")
_SHORT = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'")
_WORD = re.compile(r"[^,\]}\n#]+")


class _Twice(Exception):
    pass


class _Table:
    """``opened``: by a header of its own. ``section``: of the dotted key that last went through it.
    ``closed``: an inline table, complete where it stands."""

    __slots__ = ("children", "closed", "opened", "section")

    def __init__(self, opened: bool = False) -> None:
        self.children: dict[str, _Table | list[_Table] | None] = {}
        self.opened, self.section, self.closed = opened, 0, False


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.section = text, 1

    def key(self, i: int) -> tuple[list[str], int]:
        parts = []
        while True:
            m = _PART.match(self.text, i)
            if m["basic"] is not None:
                parts.append(_ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[3] is None else _PLAIN.get(e[3], e[3]), m["basic"]))
            else:
                parts.append(m["literal"] if m["bare"] is None else m["bare"])
            i = m.end()
            if self.text[i : i + 1] != ".":
                return parts, i
            i += 1

    def header(self, root: _Table, parts: list[str], many: bool, at: int) -> _Table:
        self.section += 1
        t = root
        for p in parts[:-1]:
            c = t.children.setdefault(p, _Table())
            t = c[-1] if isinstance(c, list) else c
            if t is None or t.closed:
                raise _Twice(at)
        had, c = parts[-1] in t.children, t.children.get(parts[-1])
        if many:
            if had and not isinstance(c, list):
                raise _Twice(at)
            new = _Table(True)
            t.children[parts[-1]] = c = c or []
            c.append(new)
            return new
        if not had:
            c = t.children[parts[-1]] = _Table()
        elif not isinstance(c, _Table) or c.opened or c.closed or c.section:
            raise _Twice(at)
        c.opened = True
        return c

    def pair(self, table: _Table, i: int) -> int:
        at = i
        parts, i = self.key(i)
        t = table
        for p in parts[:-1]:
            c = t.children.setdefault(p, _Table())
            if not isinstance(c, _Table) or c.opened or c.closed or c.section not in (0, self.section):
                raise _Twice(at)
            c.section = self.section
            t = c
        if parts[-1] in t.children:
            raise _Twice(at)
        i = _GAP.match(self.text, i + 1).end()  # past the equals sign
        t.children[parts[-1]], i = self.value(i)
        return i

    def value(self, i: int) -> tuple[_Table | None, int]:
        """(inline table or None, end) of a value."""
        c = self.text[i]
        if c == "[":
            i = _GAP.match(self.text, i + 1).end()
            while self.text[i] != "]":
                _, i = self.value(i)
                i = _GAP.match(self.text, i).end()
                if self.text[i] == ",":
                    i = _GAP.match(self.text, i + 1).end()
            return None, i + 1
        if c == "{":
            table = _Table()
            i = _GAP.match(self.text, i + 1).end()
            while self.text[i] != "}":
                i = _GAP.match(self.text, self.pair(table, i)).end()
                if self.text[i] == ",":
                    i = _GAP.match(self.text, i + 1).end()
            table.closed = True
            return table, i + 1
        return None, (_LONG.match(self.text, i) or _SHORT.match(self.text, i) or _WORD.match(self.text, i)).end()

    def run(self) -> None:
        root = table = _Table(True)
        i = _GAP.match(self.text, 0).end()
        while i < len(self.text):
            if self.text[i] == "[":
                many = self.text[i + 1 : i + 2] == "["
                parts, end = self.key(i + 1 + many)
                table = self.header(root, parts, many, i)
                i = self.text.index("]", end) + 1 + many
            else:
                i = self.pair(table, i)
            i = _GAP.match(self.text, i).end()


def repeated_key(text: str) -> int | None:
    """Where the first key or table stands that is defined already; None if there is none. The text
    must be a sentence of the grammar."""
    skip = int(text.startswith("﻿"))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(1_000_000)
    try:
        _Reader(text[skip:]).run()
    except _Twice as e:
        return e.args[0] + skip
    finally:
        sys.setrecursionlimit(limit)
    return None
