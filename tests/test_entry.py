import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {q for q in entry.queries() if q.startswith(("op", "pipeline"))}))
def test_queries_match_their_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(entry.oracle_sql()[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
