import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import catalogue, catalogue_more, catalogue_streams

QUERIES = catalogue.queries() | catalogue_more.queries() | catalogue_streams.queries()
SQL = catalogue.oracle_sql() | catalogue_more.oracle_sql() | catalogue_streams.oracle_sql()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda them, names: sorted(str([dict(zip(names, r))[c] for c in sorted(names)]) for r in them)
    assert rows([tuple(r) for r in got], df.columns) == rows(cur.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
