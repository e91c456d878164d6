"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from catalogdiff.verify.queries import QUERIES
from tests.conftest import SF_DIR, bag

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.oracle_sql()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = contract.queries()[name](spark, sf_dir)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == sorted(got.columns)
    want = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    assert bag(got) == want
    assert want
