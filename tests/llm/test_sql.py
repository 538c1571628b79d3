"""Corpus queries with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from rhetree.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert want and sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
