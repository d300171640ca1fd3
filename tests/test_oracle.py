"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import collections
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from pagemill.plans import all_queries, all_sql  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in all_sql():
        assert rows
        return
    found = duck.execute(all_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert collections.Counter(rows) == collections.Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
