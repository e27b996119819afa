"""The ten operators' queries with SQL give the SQL's rows on the smallest tables."""

import duckdb
import pytest

from textloom.llm.queries import ORACLE_SQL, QUERIES

from ..test_oracle import TABLES, plain


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    rows = QUERIES[name](spark, small)
    columns = sorted(rows.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
