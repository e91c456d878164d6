"""Catalog snapshots derived from the test tables, for queries, tests and the bench.

Each view's body runs unchanged in Spark SQL and in DuckDB, in this order. They
make two instances (``oracle_src``, ``postgres_tgt``) and a third (``zz_third``)
that differ in known ways: objects on one side only, NULL key parts, overloads,
changed column declarations, changed line counts. See FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SRC, TGT, THIRD = "oracle_src", "postgres_tgt", "zz_third"

BASE_TABLES = ("nation", "customer", "part", "orders", "lineitem", "events", "documents")

VIEWS: dict[str, str] = {
    "fx_objects_base": """
SELECT o_orderkey AS k, 'SCH_' || CAST(c_nationkey AS STRING) AS owner, 'OBJ_' || CAST(o_orderkey AS STRING) AS object_name,
 CASE WHEN o_orderkey % 2003 = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN 'TABLE' WHEN o_orderkey % 8 = 1 THEN 'PARTITIONED TABLE' WHEN o_orderkey % 8 = 2 THEN 'VIEW'
 WHEN o_orderkey % 8 = 3 THEN 'INDEX' WHEN o_orderkey % 8 = 4 THEN 'SEQUENCE' WHEN o_orderkey % 8 = 5 THEN 'PROCEDURE' WHEN o_orderkey % 8 = 6 THEN 'FUNCTION' ELSE 'TRIGGER' END AS object_type
 FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_instances": """
SELECT 'oracle_src' AS pkey, 1 AS con_id UNION ALL SELECT 'postgres_tgt', 1 UNION ALL SELECT 'zz_third', 1
""",
    "fx_dbobjectnames": """
SELECT 'oracle_src' AS pkey, 1 AS con_id, owner, object_name, object_type FROM fx_objects_base WHERE k % 13 <> 0
UNION ALL SELECT 'postgres_tgt', 1, owner, object_name, object_type FROM fx_objects_base WHERE k % 17 <> 0
UNION ALL SELECT 'postgres_tgt', 1, owner, object_name, object_type FROM fx_objects_base WHERE k % 17 <> 0 AND object_type = 'FUNCTION' AND k % 5 = 0
UNION ALL SELECT 'zz_third', 1, owner, 'ONLY3_' || object_name, object_type FROM fx_objects_base WHERE k % 997 = 0
""",
    "fx_sourcecodedetailed": """
SELECT 'oracle_src' AS pkey, 1 AS con_id, owner, object_name AS name, object_type AS type, 1 + (k % 400) AS nr_lines FROM fx_objects_base WHERE object_type IN ('PROCEDURE','FUNCTION','TRIGGER') AND k % 13 <> 0
UNION ALL SELECT 'postgres_tgt', 1, owner, object_name, object_type, 1 + (k % 400) + CASE WHEN k % 29 = 0 THEN 3 ELSE 0 END FROM fx_objects_base WHERE object_type IN ('PROCEDURE','FUNCTION','TRIGGER') AND k % 17 <> 0
""",
    "fx_sourcecode": """
SELECT pkey, con_id, owner, type, SUM(nr_lines) AS sum_nr_lines FROM fx_sourcecodedetailed GROUP BY pkey, con_id, owner, type
""",
    "fx_sourcecode_staged": """
SELECT pkey, con_id, owner, type, sum_nr_lines + CASE WHEN pkey = 'oracle_src' AND type = 'FUNCTION' THEN 7 ELSE 0 END AS sum_nr_lines FROM fx_sourcecode
""",
    "fx_columns_base": """
SELECT l_orderkey AS k, l_linenumber AS ln, b.owner, b.object_name AS table_name, 'COL_' || CAST(l_linenumber AS STRING) AS column_name, MAX(l_partkey) AS p, CAST(FLOOR(MAX(l_quantity)) AS INT) AS q, MAX(l_linestatus) AS s
 FROM lineitem JOIN fx_objects_base b ON b.k = l_orderkey WHERE b.object_type IN ('TABLE','PARTITIONED TABLE','VIEW') OR b.object_type IS NULL GROUP BY l_orderkey, l_linenumber, b.owner, b.object_name
""",
    "fx_columns": """
SELECT 'oracle_src' AS pkey, 1 AS con_id, owner, table_name, column_name, CASE WHEN p % 4 = 0 THEN 'VARCHAR2' WHEN p % 4 = 1 THEN 'NUMBER' WHEN p % 4 = 2 THEN 'DATE' ELSE 'CLOB' END AS data_type, q AS data_length, p % 38 AS data_precision, p % 5 AS data_scale, CASE WHEN s = 'F' THEN 'Y' ELSE 'N' END AS nullable FROM fx_columns_base WHERE k % 13 <> 0 AND (k * 10 + ln) % 11 <> 0
UNION ALL SELECT 'postgres_tgt', 1, owner, table_name, column_name, CASE WHEN p % 23 = 0 THEN 'RAW' WHEN p % 4 = 0 THEN 'VARCHAR2' WHEN p % 4 = 1 THEN 'NUMBER' WHEN p % 4 = 2 THEN 'DATE' ELSE 'CLOB' END, CASE WHEN p % 7 = 0 THEN NULL ELSE q END, p % 38, p % 5 + CASE WHEN p % 31 = 0 THEN 1 ELSE 0 END, CASE WHEN s = 'F' THEN 'Y' ELSE 'N' END FROM fx_columns_base WHERE k % 17 <> 0 AND (k * 10 + ln) % 19 <> 0
""",
    "fx_roleprivs": """
SELECT DISTINCT 'oracle_src' AS pkey, user_id AS grantee, event_type AS granted_role FROM events WHERE user_id % 7 <> 0 UNION ALL SELECT DISTINCT 'postgres_tgt', user_id, event_type FROM events WHERE user_id % 5 <> 0
""",
    "fx_sysprivs": """
SELECT 'oracle_src' AS pkey, c_name AS grantee, c_mktsegment AS privilege FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'postgres_tgt', c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0
""",
    "fx_indexes": """
SELECT 'oracle_src' AS pkey, 'SCH_' || CAST(p_size AS STRING) AS owner, p_brand AS table_name, 'IX_' || CAST(p_partkey AS STRING) AS index_name, CASE WHEN p_partkey % 10 = 0 THEN 'LOB' WHEN p_partkey % 37 = 0 THEN NULL ELSE 'NORMAL' END AS index_type FROM part WHERE p_partkey % 13 <> 0
UNION ALL SELECT 'postgres_tgt', 'SCH_' || CAST(p_size AS STRING), p_brand, 'IX_' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 10 = 0 THEN 'LOB' WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN 'BITMAP' ELSE 'NORMAL' END FROM part WHERE p_partkey % 17 <> 0
UNION ALL SELECT 'oracle_src', 'SCH_' || CAST(p_size AS STRING), p_brand, 'IX_' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 'BITMAP' ELSE 'LOB' END FROM part WHERE p_partkey % 17 = 0 AND p_partkey % 13 <> 0
""",
    "fx_columns_repeated": """
SELECT pkey, con_id, owner, table_name, column_name, data_type, data_length, data_precision, data_scale, nullable FROM fx_columns
UNION ALL SELECT pkey, con_id, owner, table_name, column_name, data_type, data_length + 1, data_precision, data_scale, nullable FROM fx_columns WHERE data_scale = 1
UNION ALL SELECT pkey, con_id, owner, table_name, column_name, 'RAW', data_length, data_precision, data_scale, nullable FROM fx_columns WHERE data_scale < 2 AND pkey = 'oracle_src'
UNION ALL SELECT pkey, con_id, owner, table_name, column_name, data_type, data_length, data_precision, data_scale, nullable FROM fx_columns WHERE data_precision < 9
""",
    "fx_mapped_objects": """
SELECT 'oracle_src' AS pkey, REPLACE(owner,'SCH_','SRC_') AS owner, object_name, object_type FROM fx_objects_base WHERE k % 13 <> 0 UNION ALL SELECT 'postgres_tgt', REPLACE(owner,'SCH_','TGT_'), object_name, object_type FROM fx_objects_base WHERE k % 17 <> 0
""",
    "fx_mapped_source": """
SELECT pkey, REPLACE(owner,'SCH_',CASE WHEN pkey='oracle_src' THEN 'SRC_' ELSE 'TGT_' END) AS owner, name, type FROM fx_sourcecodedetailed
""",
    "fx_mapped_columns": """
SELECT pkey, REPLACE(owner,'SCH_',CASE WHEN pkey='oracle_src' THEN 'SRC_' ELSE 'TGT_' END) AS owner, table_name, column_name FROM fx_columns
""",
    "raw_pg_namespace": """
SELECT CAST(n_nationkey AS BIGINT) AS oid, CASE WHEN n_nationkey=0 THEN 'pg_catalog' WHEN n_nationkey=1 THEN 'information_schema' WHEN n_nationkey=2 THEN 'public' WHEN n_nationkey=3 THEN 'pg_toast' ELSE LOWER(n_name) END AS nspname FROM nation
""",
    "raw_pg_class": """
SELECT o_orderkey AS oid, CASE WHEN o_orderkey % 61 = 0 THEN 'x_rowid_' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 59 = 0 THEN 'shared_' || CAST(o_orderkey % 10 AS STRING) ELSE 'rel_' || CAST(o_orderkey AS STRING) END AS relname, CAST(c_nationkey AS BIGINT) + CASE WHEN o_orderkey % 499 = 0 THEN 1000 ELSE 0 END AS relnamespace,
 SUBSTRING('rvmiStpIfc', CAST(o_orderkey % 10 AS INT) + 1, 1) AS relkind FROM orders JOIN customer ON o_custkey=c_custkey
""",
    "raw_pg_class_two": """
SELECT oid, CASE WHEN relkind IN ('v','S') THEN relname || '_two' ELSE relname END AS relname, relnamespace, relkind FROM raw_pg_class
""",
    "raw_pg_inherits": """
SELECT oid AS inhrelid, oid - 6 AS inhparent FROM raw_pg_class WHERE oid % 4 = 0 UNION ALL SELECT oid, oid - 16 FROM raw_pg_class WHERE oid % 40 = 0
""",
    "raw_pg_language": """
SELECT 13 AS oid, 'c' AS lanname UNION ALL SELECT 14, 'sql' UNION ALL SELECT 15, 'plpgsql'
""",
    "raw_pg_proc": """
SELECT doc_id AS oid, 'fn_' || CAST(doc_id % 700 AS STRING) AS proname, doc_id % 25 AS pronamespace, SUBSTRING('ffpaw', CAST(doc_id % 5 AS INT) + 1, 1) AS prokind, CASE WHEN doc_id % 9 = 0 THEN 14 ELSE 15 END AS prolang, CASE WHEN doc_id % 101 = 0 THEN NULL ELSE text END AS definition FROM documents
""",
    "raw_pg_trigger": """
SELECT p_partkey AS oid, 'trg_' || CAST(p_partkey AS STRING) AS tgname, p_partkey * 7 AS tgrelid, p_partkey % 6 = 0 AS tgisinternal, SUBSTRING('ODRA', CAST(p_partkey % 4 AS INT) + 1, 1) AS tgenabled FROM part
""",
    "raw_pg_info_columns": """
SELECT DISTINCT n.nspname AS table_schema, c.relname AS table_name, CASE WHEN l_linenumber = 7 THEN 'rowid' ELSE 'col_' || CAST(l_linenumber AS STRING) END AS column_name, CASE WHEN l_linenumber % 3 = 0 THEN 'character varying' WHEN l_linenumber % 3 = 1 THEN 'numeric' ELSE 'date' END AS data_type, CASE WHEN l_linenumber % 3 = 0 THEN 100 END AS character_maximum_length, CASE WHEN l_linenumber % 3 = 1 THEN 38 END AS numeric_precision, CASE WHEN l_linenumber % 3 = 1 THEN 2 END AS numeric_scale, CASE WHEN l_linenumber % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable FROM lineitem JOIN raw_pg_class c ON c.oid = l_orderkey JOIN raw_pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r','v','m','p')
""",
    "raw_pg_info_views": """
SELECT n.nspname AS table_schema, c.relname AS table_name FROM raw_pg_class c JOIN raw_pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = 'v'
""",
    "raw_ora_objects": """
SELECT CASE WHEN c_nationkey = 0 THEN 'SYS' WHEN c_nationkey = 1 THEN 'SYSTEM' ELSE 'sch_' || CAST(c_nationkey AS STRING) END AS owner, CASE WHEN o_orderkey % 53 = 0 THEN 'DR$IDX_' || CAST(o_orderkey AS STRING) ELSE 'OBJ_' || CAST(o_orderkey AS STRING) END AS object_name,
 CASE WHEN o_orderkey % 7 = 1 AND o_orderkey % 3 <> 0 THEN 'P' || CAST(o_orderkey % 4 AS STRING) END AS subobject_name, CASE WHEN o_orderkey % 7 = 0 THEN 'TABLE' WHEN o_orderkey % 7 = 1 THEN 'TABLE PARTITION' WHEN o_orderkey % 7 = 2 THEN 'VIEW' WHEN o_orderkey % 7 = 3 THEN 'INDEX' WHEN o_orderkey % 7 = 4 THEN 'LOB' WHEN o_orderkey % 7 = 5 THEN 'PACKAGE BODY' ELSE 'SEQUENCE' END AS object_type FROM orders JOIN customer ON o_custkey=c_custkey
""",
    "raw_ora_objects_two": """
SELECT owner, CASE WHEN object_type IN ('VIEW','SEQUENCE') THEN object_name || '_TWO' ELSE object_name END AS object_name, subobject_name, object_type FROM raw_ora_objects
""",
    "raw_ora_tab_partitions": """
SELECT owner AS table_owner, object_name AS table_name, 'P1' AS partition_name FROM raw_ora_objects WHERE object_type='TABLE' AND object_name LIKE '%5' UNION ALL SELECT owner, object_name, 'P2' FROM raw_ora_objects WHERE object_type='TABLE' AND object_name LIKE '%5'
""",
    "raw_ora_source": """
SELECT CASE WHEN l_suppkey % 50 = 0 THEN 'SYS' ELSE 'sch_' || CAST(l_suppkey % 25 AS STRING) END AS owner, 'PKG_' || CAST(l_orderkey AS STRING) AS name, CASE WHEN l_returnflag = 'A' THEN 'PROCEDURE' WHEN l_returnflag = 'N' THEN 'FUNCTION' ELSE 'PACKAGE BODY' END AS type, l_linenumber AS line FROM lineitem
""",
    "raw_ora_tab_columns": """
SELECT o.owner, o.object_name AS table_name, 'COL_' || CAST(l_linenumber AS STRING) AS column_name, MAX(CASE WHEN l_partkey % 4 = 0 THEN 'VARCHAR2' WHEN l_partkey % 4 = 1 THEN 'NUMBER' WHEN l_partkey % 4 = 2 THEN 'DATE' ELSE 'CLOB' END) AS data_type, CAST(FLOOR(MAX(l_quantity)) AS INT) AS data_length, MAX(CASE WHEN l_partkey % 4 = 1 THEN 38 END) AS data_precision, MAX(CASE WHEN l_partkey % 4 = 1 THEN 2 END) AS data_scale, MAX(CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END) AS nullable, l_linenumber AS column_id FROM lineitem JOIN raw_ora_objects o ON o.object_name = 'OBJ_' || CAST(l_orderkey AS STRING) WHERE o.object_type IN ('TABLE','VIEW') GROUP BY o.owner, o.object_name, l_linenumber
""",
    "raw_ora_views": """
SELECT owner, object_name AS view_name FROM raw_ora_objects WHERE object_type = 'VIEW'
""",
    "raw_ora_triggers": """
SELECT owner, 'TRG_' || object_name AS trigger_name, object_name AS table_name, CASE WHEN object_name LIKE '%3' THEN 'DISABLED' ELSE 'ENABLED' END AS status FROM raw_ora_objects WHERE object_type = 'TABLE'
""",
    "fx_staged_instances": """
SELECT pkey, con_id FROM fx_dbobjectnames
""",
    "fx_fleet_instances": """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'oracle_' ELSE 'postgres' END || c_name AS pkey, 1 AS con_id FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_three_sources": """
SELECT pkey, owner, name, type FROM fx_sourcecodedetailed UNION ALL SELECT 'zz_third', owner, 'ONLY3_' || name, type FROM fx_sourcecodedetailed
""",
    "fx_mapped_names": """
SELECT pkey, REPLACE(owner,'SCH_',CASE WHEN pkey='oracle_src' THEN 'SRC_' ELSE 'TGT_' END) AS owner, CASE WHEN k % 11 = 0 THEN NULL ELSE object_name END AS object_name, object_type
 FROM (SELECT 'oracle_src' AS pkey, * FROM fx_objects_base WHERE k % 13 <> 0 UNION ALL SELECT 'postgres_tgt', * FROM fx_objects_base WHERE k % 17 <> 0) b
""",
    "fleet_pg_namespace": """
SELECT DISTINCT 'postgres_' || LOWER(c_mktsegment) AS pkey, n.oid, n.nspname FROM customer JOIN raw_pg_namespace n ON n.oid = c_nationkey
""",
    "fleet_pg_class": """
SELECT 'postgres_' || LOWER(c_mktsegment) AS pkey, r.oid, r.relname, r.relnamespace, r.relkind FROM raw_pg_class r JOIN orders ON o_orderkey = r.oid JOIN customer ON c_custkey = o_custkey
 UNION ALL SELECT 'postgres_' || LOWER(c_mktsegment), r.oid + 1, r.relname, r.relnamespace, r.relkind FROM raw_pg_class r JOIN orders ON o_orderkey = r.oid + 1 JOIN customer ON c_custkey = o_custkey
""",
    "fleet_pg_inherits": """
SELECT pkey, oid AS inhrelid, oid - 6 AS inhparent FROM fleet_pg_class WHERE oid % 4 = 0
""",
    "fleet_pg_language": """
SELECT DISTINCT pkey, 15 AS oid, 'plpgsql' AS lanname FROM fleet_pg_namespace UNION ALL SELECT DISTINCT pkey, 14, 'sql' FROM fleet_pg_namespace
""",
    "fleet_pg_proc": """
SELECT n.pkey, p.oid, p.proname, p.pronamespace, p.prokind, p.prolang, p.definition FROM raw_pg_proc p JOIN fleet_pg_namespace n ON n.oid = p.pronamespace
""",
    "fleet_pg_trigger": """
SELECT c.pkey, t.oid, t.tgname, t.tgrelid, t.tgisinternal, t.tgenabled FROM raw_pg_trigger t JOIN fleet_pg_class c ON c.oid = t.tgrelid
""",
    "fleet_ora_objects": """
SELECT 'oracle_' || LOWER(c_mktsegment) AS pkey, CASE WHEN c_nationkey = 0 THEN 'SYS' ELSE 'sch_' || CAST(c_nationkey AS STRING) END AS owner, 'OBJ_' || CAST(o_orderkey % 500 AS STRING) AS object_name,
 'P' || CAST(o_orderkey % 4 AS STRING) AS subobject_name, CASE WHEN o_orderkey % 3 = 0 THEN 'TABLE' WHEN o_orderkey % 3 = 1 THEN 'TABLE PARTITION' ELSE 'LOB' END AS object_type FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fleet_ora_tab_partitions": """
SELECT pkey, owner AS table_owner, object_name AS table_name FROM fleet_ora_objects WHERE object_type = 'TABLE PARTITION'
""",
}


# One database and eight that each lack something of it, with overloads on both sides.
STAR = [f"star_{n}" for n in range(8)]
VIEWS["fx_star_objects"] = "".join(
    f"{' UNION ALL ' if i else ''}SELECT '{pkey}' AS pkey, 1 AS con_id, owner, object_name, object_type FROM fx_objects_base WHERE {kept}\n"
    for i, (pkey, kept) in enumerate(
        [(SRC, "true"), (SRC, "object_type = 'FUNCTION' AND k % 5 = 0")]
        + [(s, f"k % {11 + n} <> 0") for n, s in enumerate(STAR)]
        + [(s, "object_type = 'FUNCTION' AND k % 10 = 0") for s in STAR[:2]]
        + [(STAR[0], "object_type = 'VIEW' AND k % 3 = 0 AND k % 11 = 0")]
    )
)
VIEWS["fx_star_instances"] = "SELECT DISTINCT pkey, 1 AS con_id FROM fx_star_objects"


def _each(*rows: tuple[str, str]) -> str:
    """The rows ``(value, condition)`` that a row of the table becomes."""
    return "inline(filter(array(" + ", ".join(f"IF({kept}, {value}, NULL)" for value, kept in rows) + "), r -> r IS NOT NULL))"


def _column(pkey: str, data_type: str, data_length: str, data_scale: str) -> str:
    return (
        f"struct('{pkey}' AS pkey, 1 AS con_id, owner, table_name, column_name, {data_type} AS data_type, {data_length} AS data_length,"
        f" p % 38 AS data_precision, {data_scale} AS data_scale, CASE WHEN s = 'F' THEN 'Y' ELSE 'N' END AS nullable)"
    )


_TYPES = "WHEN p % 4 = 0 THEN 'VARCHAR2' WHEN p % 4 = 1 THEN 'NUMBER' WHEN p % 4 = 2 THEN 'DATE' ELSE 'CLOB' END"
_DECLARED = "struct(data_type, data_length)"

# The same rows as the view of that name, in Spark: a union reads and joins its tables again for each of its parts, these forms do it once.
ONE_PASS: dict[str, str] = {
    "fx_columns": "SELECT "
    + _each(
        (_column(SRC, f"CASE {_TYPES}", "q", "p % 5"), "k % 13 <> 0 AND (k * 10 + ln) % 11 <> 0"),
        (
            _column(TGT, f"CASE WHEN p % 23 = 0 THEN 'RAW' {_TYPES}", "CASE WHEN p % 7 = 0 THEN NULL ELSE q END", "p % 5 + CASE WHEN p % 31 = 0 THEN 1 ELSE 0 END"),
            "k % 17 <> 0 AND (k * 10 + ln) % 19 <> 0",
        ),
    )
    + " FROM fx_columns_base",
    "fx_columns_repeated": "SELECT pkey, con_id, owner, table_name, column_name, d.data_type, d.data_length, data_precision, data_scale, nullable FROM fx_columns LATERAL VIEW "
    + _each(
        (_DECLARED, "true"),
        ("struct(data_type, data_length + 1 AS data_length)", "data_scale = 1"),
        ("struct('RAW' AS data_type, data_length)", f"data_scale < 2 AND pkey = '{SRC}'"),
        (_DECLARED, "data_precision < 9"),
    )
    + " d AS data_type, data_length",
}


def needed(*names: str) -> list[str]:
    """The given views and the views they read, in order of definition."""
    want, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in want:
            want.add(name)
            todo += [v for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[name])]
    return [v for v in VIEWS if v in want]


def ctes(*names: str) -> str:
    """The views as common table expressions of DuckDB, for a query that must be one statement; each is made once."""
    return "WITH " + ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in needed(*names))


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The views as DataFrames over the parquet tables of ``sf_dir``."""
    for table in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for name in needed(*names):
        spark.sql(ONE_PASS.get(name, VIEWS[name])).createOrReplaceTempView(name)
    return [spark.table(name) for name in names]
