"""Every series query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from seriesforge.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_oracle(spark, db, sf, name):
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in cols)
    assert got and got == sorted(db.execute(f"SELECT {names} FROM ({Q.oracle_sql()[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() == 1
