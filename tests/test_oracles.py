"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(row[names.index(c)]) for c in cols) for row in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.limit(5).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
