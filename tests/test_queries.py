"""Every registered query on the smallest tables; those with SQL against DuckDB."""

import os

import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 6) + 0.0)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        return
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "score", "matches", "bm25_rank"]


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
