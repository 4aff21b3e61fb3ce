"""Every registered query with SQL against DuckDB over the smallest tables."""

import os

import pytest

from tidemark.plans import all_oracles, all_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "quantize"):
            return v
        return round(float(v), 4) if abs(float(v)) < 1e12 else int(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_against_sql(spark, duck, name):
    df = all_queries()[name](spark, DATA)
    found = df.collect()
    wanted = duck.sql(all_oracles()[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, found) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_without_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    assert all_queries()[name](spark, DATA).count() > 0
