"""Column expressions on strings that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: Unicode White_Space plus the four ASCII separators (fixed values).
_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_path(path: Column | str) -> Column:
    """Forward slashes only, no repeated separators, no ``./`` segments. Null stays null. Only paths
    that may not be plain yet meet the patterns."""
    c = F.col(path) if isinstance(path, str) else path
    p = F.regexp_replace(c, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    return F.when(c.contains("\\") | c.contains("//") | c.contains("./"), p).otherwise(c)


def strip_space(c: Column | str) -> Column:
    """Remove white space of any kind (Unicode included) at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(_WS))


def blank_to_null(c: Column | str) -> Column:
    """The stripped value, or null where nothing is left."""
    s = strip_space(c)
    return F.when(s != "", s)


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
