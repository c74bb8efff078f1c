"""Every query that has SQL gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from chunkwright.plans.catalog import ORACLES, QUERIES
from chunkwright.plans.corpora import decorated, table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, duck):
    frame = QUERIES[name](spark, SF_DIR)
    got = sorted(tuple(normal(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    places = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(frame.columns)
    assert got == sorted(tuple(normal(row[i]) for i in places) for row in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark):
    rows = QUERIES[name](spark, SF_DIR)
    assert rows.count() > 0 and rows.dropna(how="all").count() > 0


def test_decorated_documents_keep_every_line(spark):
    both = decorated(spark, SF_DIR).join(table(spark, SF_DIR, "documents").selectExpr("doc_id", "text AS plain"), "doc_id").collect()
    assert both and all(line in row["text"] for row in both for line in row["plain"].split("\n"))
    assert all(len(row["text"]) >= len(row["plain"]) for row in both)
