"""The fixtures over rows of the test's own: which objects have columns, and one-pass forms."""

from __future__ import annotations

import pytest

from catalogdiff.verify import fixtures
from catalogdiff.verify.fixtures import BASE_TABLES, ONE_PASS, TGT, views
from conftest import bag

# 16024 is a multiple of 2003, so the type of that object is NULL; 8 is a table, 10 a view, 11 an index, 13 a procedure.
ORDERS = {16024: 1, 8: 1, 10: 2, 11: 1, 13: 2, 5: None, 30: 2, 46: 1, 70: 1}


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    own = {
        "customer": spark.sql("SELECT 1L AS c_custkey, 3 AS c_nationkey, 'a' AS c_name, 'x' AS c_mktsegment UNION ALL SELECT 2L, 4, 'b', 'y'"),
        "orders": spark.createDataFrame(list(ORDERS.items()), "o_orderkey long, o_custkey long"),
        "lineitem": spark.range(240).selectExpr(
            f"element_at(array({', '.join(map(str, ORDERS))}), int(id % {len(ORDERS)}) + 1) * 1L AS l_orderkey", "int(id div 40) AS l_linenumber",
            "id * 31 AS l_partkey", "id * 1.5D AS l_quantity", "IF(id % 3 = 0, 'F', 'O') AS l_linestatus",
        ),
    }
    for name in BASE_TABLES:
        rows = own[name] if name in own else spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(5)
        rows.write.parquet(f"{path}/{name}.parquet")
    return path


def test_objects_without_a_type_have_columns(spark, tables):
    (columns,) = views(spark, tables, "fx_columns")
    found = {r[0] for r in columns.where(f"pkey = '{TGT}'").select("table_name").collect()}
    assert found == {"OBJ_16024", "OBJ_8", "OBJ_10"}


@pytest.mark.parametrize("name", list(ONE_PASS))
def test_one_pass_has_the_rows_of_the_view(spark, tables, name, monkeypatch):
    (once,) = views(spark, tables, name)
    assert bag(once)
    monkeypatch.setattr(fixtures, "ONE_PASS", {})
    (union,) = views(spark, tables, name)
    assert once.dtypes == union.dtypes
    assert bag(once) == bag(union)


def test_columns_read_their_tables_once(spark, tables):
    (columns,) = views(spark, tables, "fx_columns_repeated")
    scans = [line for line in columns._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "l_orderkey" in line]
    assert len(scans) == 1
