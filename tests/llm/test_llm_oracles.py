"""Queries that SQL can express, against that SQL."""

from __future__ import annotations

import duckdb
import pytest

from catalogdiff.llm.oracles import ORACLES
from catalogdiff.llm.queries import QUERIES
from tests.conftest import bag


@pytest.mark.parametrize("name", list(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    got = QUERIES[name](spark, folder)
    assert [names[i] for i in order] == sorted(got.columns)
    assert bag(got) == sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
