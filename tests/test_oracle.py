"""Every query against its DuckDB statement on the smallest test tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from taskfold.plans.catalog import all_queries as queries
from taskfold.plans.oracle import statements as oracle_sql

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_entry(spark):
    assert entry(spark).columns == ["project_id", "id", "name", "status", "recency_score"]


def test_every_query_has_a_statement():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df, rel = queries()[name](spark, FOLDER), db.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert comparable(df.columns, df.collect()) == comparable(rel.columns, rel.fetchall())
