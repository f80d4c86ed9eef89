"""Secrets in texts: found by shape, by the name they are given, or by how random they look.

All masks keep the length of what they hide, so spans into a text stay right. Functions take one text;
:func:`column` makes an Arrow-batched column of one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of credentials (fixed values); where a pattern has a group, only that is masked.
SHAPES = (
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,255}",
    r"github_pat_[A-Za-z0-9_]{22,255}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"xox[abposr]-[A-Za-z0-9\-]{10,}",
    r"hooks\.slack\.com/services/([A-Za-z0-9/]{16,})",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}\b",
    r"\bnpm_[A-Za-z0-9]{36}\b",
    r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----([A-Za-z0-9+/=\s\\:,\-]*?)-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----",
)
#: Words, and pairs of words, in the name of a secret (fixed values).
SECRET_WORDS = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "secrets", "token", "tokens", "credential", "credentials", "creds", "auth", "oauth", "authorization", "cert",
    "signature", "salt", "session", "cookie", "dsn", "private", "apikey", "accesskey", "secretkey", "privatekey", "connectionstring", "bearer")
SECRET_PAIRS = (("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"), ("client", "secret"), ("connection", "string"))

_SHAPES = [re.compile(p) for p in SHAPES]
_USERINFO = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]*://([^\s/@'\"<>()]+)@")
_ASSIGNED = re.compile(r"""(["']?)([A-Za-z_][\w.\-]*)\1[ \t]*(?::=|=|:)[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s,;)'"\\<>]+))""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])")
_BASE64 = re.compile(r"(?<![0-9A-Za-z+/_\-])[0-9A-Za-z+/_\-]{24,}={0,2}")
_SEGMENT = re.compile(r"[0-9A-Za-z]{16,}")
Ranges = list[tuple[int, int]]


def merged(ranges: Ranges) -> Ranges:
    """Ranges in order, those that overlap or touch made one."""
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mask(text: str, ranges: Ranges) -> str:
    """``text`` with asterisks for the ranges; line breaks stay."""
    out, at = [], 0
    for a, b in merged(ranges):
        out.append(text[at:a])
        out.append(re.sub(r"[^\r\n]", "*", text[a:b]))
        at = b
    return "".join(out) + text[at:]


def shape_ranges(text: str) -> Ranges:
    """Where known shapes of credentials stand, and users' names in URLs that may be secrets: with a
    password, or of twelve characters and more."""
    out = []
    for p in _SHAPES:
        for m in p.finditer(text):
            out.append(m.span(1 if p.groups and m[1] is not None else 0))
    out += [m.span(1) for m in _USERINFO.finditer(text) if ":" in m[1] or len(m[1]) >= 12]
    return merged(out)


def names_secret(name: str) -> bool:
    """Whether a key names a secret, in any case style."""
    words = [w.lower() for w in _WORD.findall(name)]
    return any(w in SECRET_WORDS for w in words) or any(p in SECRET_PAIRS for p in zip(words, words[1:]))


def free_text_ranges(text: str) -> Ranges:
    """Shapes, and the values prose or code gives to keys that name a secret."""
    out = shape_ranges(text)
    for m in _ASSIGNED.finditer(text):
        if names_secret(m[2]):
            g = next(g for g in (3, 4, 5) if m[g] is not None)
            if m[g]:
                out.append(m.span(g))
    return merged(out)


def entropy(text: str) -> float:
    """Bits per byte; 0 for nothing."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    return -sum(c / n * math.log2(c / n) for c in Counter(raw).values()) + 0.0 if n else 0.0


def value_ranges(value: str) -> Ranges:
    """What looks random in a value: 32 hex digits and more, 24 characters of base64 and more with
    an entropy of 4 bits, runs of 16 letters and digits that mix both cases and digits."""
    out = [m.span() for m in _HEX.finditer(value)]
    out += [m.span() for m in _BASE64.finditer(value) if entropy(m.group()) >= 4.0]
    out += [m.span() for m in _SEGMENT.finditer(value) if re.search(r"\d", m.group()) and re.search(r"[a-z]", m.group()) and re.search(r"[A-Z]", m.group())]
    return merged(out)


_PLAIN_VALUE = re.compile(r"(?i)true|false|null|none|yes|no|on|off|[+-]?\d+(?:\.\d+)*\w{0,3}|[a-z][a-z-]{0,15}")


def redact_config(text: str, path: str) -> str:
    """A configuration text with every value masked that isn't plainly harmless (a truth value, a
    number, a short lower-case word), by the format of its extension: JSON strings, ``key = value``
    and ``key: value`` lines of the others. Other files are redacted as free text."""
    ext = path.rpartition(".")[2].lower()
    if ext == "json":
        spans = [m.span(1) for m in re.finditer(r'"((?:[^"\\]|\\.)*)"(\s*:)?', text) if not m[2]]
    elif ext in ("toml", "ini", "env", "properties", "yaml", "yml", "conf", "cfg"):
        spans = []
        for m in re.finditer(r"(?m)^[ \t-]*[\"']?[\w.\-]+[\"']?[ \t]*[:=][ \t]*([^\n#]*?)[ \t]*(?:#[^\n]*)?$", text):
            quoted = [q.span(1) for q in re.finditer(r"[\"']([^\"'\n]*)[\"']", m[1])]
            spans += [(m.start(1) + a, m.start(1) + b) for a, b in quoted] or [m.span(1)]
    else:
        return mask(text, free_text_ranges(text))
    return mask(text, free_text_ranges(text) + [(a, b) for a, b in spans if a < b and not _PLAIN_VALUE.fullmatch(text[a:b])])


def redact_free_text(text: str) -> str:
    return mask(text, free_text_ranges(text))


def redact_shapes(text: str) -> str:
    return mask(text, shape_ranges(text))


def redact_values(text: str) -> str:
    return mask(text, value_ranges(text))


def column(f: Callable, *columns: str, kind: str = "string") -> Column:
    """``f`` of text columns, Arrow batch by Arrow batch; null if any of them is."""
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*cols)], dtype=object)

    return (_one if len(columns) == 1 else _two)(run, kind)(*columns)


def _one(run: Callable, kind: str):
    def f(a: pd.Series) -> pd.Series:
        return run(a)

    return F.pandas_udf(f, kind)


def _two(run: Callable, kind: str):
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(f, kind)
