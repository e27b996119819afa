"""Every registered query with SQL gives the SQL's rows on the smallest tables; test_without_sql.py has the others."""

import duckdb
import pytest

from textloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return f"{x:.6f}"
    return str(x)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, small, duck, name):
    rows = registry.QUERIES[name](spark, small)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
