"""Arrow-batched JSON helpers: strict validity, canonical form and field extraction.

The JVM's JSON functions accept more than RFC 8259 (single quotes, trailing content), so
validity and value equality are decided by a strict parser over Arrow batches.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _refuse(name: str):
    raise ValueError(name)


def strict_loads(text: str, **kw):
    """Parse strictly: NaN and infinities are errors, as is anything after the value."""
    return json.loads(text, parse_constant=_refuse, **kw)


def _number(text: str):
    d = Decimal(text)
    if not d.is_finite():
        return text
    t = d.normalize().as_tuple()
    return ("#", t.sign if any(t.digits) else 0, "".join(map(str, t.digits)), t.exponent if any(t.digits) else 0)


def canonical_json(text: str | None) -> str | None:
    """One spelling per JSON value: members sorted, white space and escapes gone, numbers by
    value. Text that is no JSON comes back as itself behind a marker, so it equals only itself."""
    if text is None:
        return None
    try:
        v = strict_loads(text, parse_int=_number, parse_float=_number)
        return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except (ValueError, RecursionError, ArithmeticError):
        return "!" + text


def canonical_json_udf(c: Column) -> Column:
    """:func:`canonical_json` of a column. Spellings seen before come from a memo, which starts
    afresh beyond 16 million characters: full snapshots repeat most of their records."""

    def spell(s: pd.Series) -> pd.Series:
        memo, held = _seen
        out = []
        for t in s:
            v = memo.get(t) if t is not None else None
            if v is None and t is not None:
                v = canonical_json(t)
                held[0] += len(t) + len(v)
                if held[0] > 16_000_000:
                    memo.clear()
                    held[0] = len(t) + len(v)
                memo[t] = v
            out.append(v)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(spell, "string")(c)


_seen: tuple[dict[str, str], list[int]] = ({}, [0])
