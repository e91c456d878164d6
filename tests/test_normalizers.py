"""Each branch of the normalisers on small raw catalogs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalogdiff import normalize_oracle, normalize_postgres
from catalogdiff.functions import line_count, regclass_text
from catalogdiff.operators import (
    ora_columns,
    ora_objects,
    ora_source_lines,
    pg_columns,
    pg_objects,
    pg_source_lines,
    pg_triggers,
    sourcecode_rollup,
    supplied,
)
from catalogdiff.schemas import STAGED


@pytest.fixture(scope="module")
def pg(spark):
    frame = spark.createDataFrame
    classes = [
        (1, "t_plain", 10, "r"), (2, "t_child", 10, "r"), (3, "v_one", 10, "v"), (4, "m_one", 10, "m"),
        (5, "i_one", 10, "i"), (6, "i_child", 10, "i"), (7, "ip_one", 10, "I"), (8, "ip_child", 10, "I"),
        (9, "s_one", 10, "S"), (10, "low_s", 10, "s"), (11, "toast_one", 10, "t"), (12, "p_one", 10, "p"),
        (13, "f_one", 10, "f"), (14, "hidden", 11, "r"), (15, "dangling", 99, "r"), (16, "x_rowid_y", 10, "r"),
        (17, "pub", 12, "r"), (18, "t_plain", 13, "r"), (19, "Order", 13, "r"), (20, "toasted", 14, "t"),
    ]
    return {
        "pg_namespace": frame(
            [(10, "app"), (11, "pg_catalog"), (12, "public"), (13, "other"), (14, "pg_toast")], "oid bigint, nspname string"
        ),
        "pg_class": frame(classes, "oid bigint, relname string, relnamespace bigint, relkind string"),
        "pg_inherits": frame([(2, 1), (2, 12), (6, 5), (8, 7)], "inhrelid bigint, inhparent bigint"),
        "pg_language": frame([(1, "c"), (2, "plpgsql")], "oid bigint, lanname string"),
        "pg_proc": frame(
            [("p1", 10, "p", 2, "a\nb\n"), ("f1", 10, "f", 2, "one"), ("f1", 10, "f", 2, None), ("agg", 10, "a", 2, ""),
             ("cfn", 10, "f", 1, "x"), ("sys", 11, "f", 2, "x")],
            "proname string, pronamespace bigint, prokind string, prolang bigint, definition string",
        ),
        "pg_trigger": frame(
            [("tr1", 1, False, "O"), ("tr2", 1, True, "O"), ("tr3", 17, False, "D"), ("tr4", 19, False, "D"), ("tr5", 14, False, "O")],
            "tgname string, tgrelid bigint, tgisinternal boolean, tgenabled string",
        ),
        "columns": frame(
            [("app", "t_plain", "c1", "integer"), ("app", "t_plain", "rowid", "integer"), ("app", "t_child", "c1", "integer"),
             ("pg_catalog", "hidden", "c1", "integer"), ("other", "t_plain", "c1", "integer")],
            "table_schema string, table_name string, column_name string, data_type string",
        ).select(
            "*",
            F.lit(None).cast("int").alias("character_maximum_length"),
            F.lit(32).alias("numeric_precision"),
            F.lit(0).alias("numeric_scale"),
            F.lit("YES").alias("is_nullable"),
        ),
        "views": frame([("app", "v_one"), ("information_schema", "v")], "table_schema string, table_name string"),
    }


def test_relation_kinds(pg):
    got = pg_objects(pg, "p").where("object_type not in ('PROCEDURE', 'FUNCTION', 'TRIGGER') and owner = 'APP'")
    assert sorted((r["object_name"], r["object_type"]) for r in got.collect()) == [
        ("IP_CHILD", "I"), ("IP_ONE", "INDEX"), ("I_ONE", "INDEX"), ("M_ONE", "MATERIALIZED VIEW"),
        ("P_ONE", "PARTITIONED TABLE"), ("S_ONE", "SEQUENCE"), ("TOAST_ONE", "TOAST TABLE"),
        ("T_CHILD", "TABLE PARTITION"), ("T_CHILD", "TABLE PARTITION"), ("T_PLAIN", "TABLE"), ("V_ONE", "VIEW"),
    ]


def test_system_schemas_and_dangling_relations_are_dropped(pg):
    found = pg_objects(pg, "p").where("object_type <> 'TRIGGER'")
    owners = {r["owner"] for r in found.select("owner").distinct().collect()}
    assert owners == {"APP", "PUBLIC", "OTHER"}


def test_routines_and_triggers_among_objects(pg):
    rows = pg_objects(pg, "p").where("object_type in ('PROCEDURE', 'FUNCTION', 'TRIGGER')").collect()
    # Overloads stay, the aggregate and the C function do not; tr5's schema is not hidden for triggers.
    assert sorted((r["object_name"], r["object_type"]) for r in rows) == [
        ("F1", "FUNCTION"), ("F1", "FUNCTION"), ("P1", "PROCEDURE"), ("TR1", "TRIGGER"), ("TR4", "TRIGGER"), ("TR5", "TRIGGER"),
    ]


def test_owner_filter_compares_folded_names(pg):
    assert {r["owner"] for r in pg_objects(pg, "p", ["OTHER"]).collect()} == {"OTHER"}
    assert pg_objects(pg, "p", ["other"]).count() == 0


def test_source_lines(pg):
    got = [(r["name"], r["type"], r["nr_lines"]) for r in pg_source_lines(pg, "p").collect()]
    assert sorted(got, key=repr) == [("AGG", None, 1), ("F1", "FUNCTION", 0), ("F1", "FUNCTION", 1), ("P1", "PROCEDURE", 3)]


def test_line_count(spark):
    texts = spark.createDataFrame([(None,), ("",), ("a",), ("a\n",), ("\n\n",), ("a\r\nb",)], "t string")
    assert [r[0] for r in texts.selectExpr(line_count("t")).collect()] == [0, 1, 1, 2, 3, 2]


def test_columns_join_on_schema_and_name(pg):
    got = sorted((r["owner"], r["table_name"], r["column_name"]) for r in pg_columns(pg, "p").collect())
    assert got == [("APP", "T_PLAIN", "C1"), ("OTHER", "T_PLAIN", "C1")]
    assert pg_columns(pg, "p", compat=True).count() == 4


def test_trigger_tables_are_printed_as_regclass(pg):
    got = sorted((r["owner"], r["trigger_name"], r["table_name"], r["status"]) for r in pg_triggers(pg, "p").collect())
    assert got == [
        ("app", "tr1", "app.t_plain", "O"), ("other", "tr4", 'other."Order"', "D"), ("pg_catalog", "tr5", "hidden", "O"),
    ]
    on_path = pg_triggers(pg, "p", search_path=["app"]).where("owner = 'app'").collect()
    assert [r["table_name"] for r in on_path] == ["t_plain"]


def test_identifier_quoting(spark):
    names = spark.createDataFrame([("s", "plain_1"), ("My Schema", 'say"so'), ("s", "user"), ("s", "1st")], "s string, n string")
    got = [r[0] for r in names.selectExpr(regclass_text("s", "n", ())).collect()]
    assert got == ["s.plain_1", '"My Schema"."say""so"', 's."user"', 's."1st"']


def test_databases_with_equal_oids_do_not_mix(pg):
    one = {t: df.withColumn("pkey", F.lit("db1")) for t, df in pg.items()}
    two = {t: df.withColumn("pkey", F.lit("db2")) for t, df in pg.items()}
    both = normalize_postgres({t: one[t].unionByName(two[t]) for t in pg})
    alone = normalize_postgres(pg, "db1")
    for table, rows in both.items():
        assert rows.columns == STAGED[table].names
        assert rows.where("pkey = 'db1'").count() == rows.where("pkey = 'db2'").count() == alone[table].count()


@pytest.fixture(scope="module")
def ora(spark):
    frame = spark.createDataFrame
    return {
        "objects": frame(
            [("app", "T1", None, "TABLE"), ("app", "T1", "P1", "TABLE PARTITION"), ("app", "T1", None, "TABLE PARTITION"),
             ("app", "T2", None, "TABLE"), ("app", "DR$IDX_9$I", None, "TABLE"), ("app", "DR$IDX", None, "TABLE"),
             ("app", "L1", None, "LOB"), ("SYS", "T1", None, "TABLE"), ("Sys", "T1", None, "TABLE"), (None, "T1", None, "TABLE")],
            "OWNER string, OBJECT_NAME string, SUBOBJECT_NAME string, OBJECT_TYPE string",
        ),
        "tab_partitions": frame([("app", "T1"), ("app", "T1"), ("app", "DR$IDX")], "TABLE_OWNER string, TABLE_NAME string"),
        "source": frame(
            [("app", "P", "PROCEDURE", 1), ("app", "P", "PROCEDURE", 7), ("APP", "P", "PROCEDURE", 2), ("SYSTEM", "P", "PROCEDURE", 2)],
            "owner string, name string, type string, line int",
        ),
        "tab_columns": frame(
            [("app", "T1", "C", "NUMBER", 22, 10, 2, "Y", 1), ("SYS", "T", "C", "NUMBER", 22, 10, 2, "Y", 1)],
            "owner string, table_name string, column_name string, data_type string, data_length int,"
            " data_precision int, data_scale int, nullable string, column_id int",
        ),
        "views": frame([("app", "V")], "owner string, view_name string"),
        "triggers": frame([("app", "TR", "T1", "ENABLED")], "owner string, trigger_name string, table_name string, status string"),
    }


def test_oracle_objects(ora):
    got = sorted((r["owner"], r["object_name"], r["object_type"]) for r in ora_objects(ora, "o").collect())
    assert got == [
        ("APP", "DR$IDX", "PARTITIONED TABLE"),
        ("APP", "DR$IDX_9$I *Warning: FULL TEXT SEARCH INDEX*", "TABLE"),
        ("APP", "T1", "PARTITIONED TABLE"),
        ("APP", "T1_", "TABLE PARTITION"),
        ("APP", "T1_P1", "TABLE PARTITION"),
        ("APP", "T2", "TABLE"),
        ("SYS", "T1", "TABLE"),
    ]


def test_oracle_owner_filter_compares_raw_owners(ora):
    assert ora_objects(ora, "o", ["app"]).count() == 6
    assert ora_objects(ora, "o", ["APP"]).count() == 0


def test_oracle_source_lines_group_raw_owners(ora):
    got = sorted((r["owner"], r["nr_lines"]) for r in ora_source_lines(ora, "o").collect())
    assert got == [("APP", 2), ("APP", 7)]


def test_oracle_user_scope(ora):
    mine = {t: df.drop("owner", "OWNER", "TABLE_OWNER") for t, df in ora.items()}
    staged = normalize_oracle(mine, "o", scope="user", user="scott")
    assert {r["owner"] for r in staged["dbobjectnames"].collect()} == {"SCOTT"}
    assert staged["sourcecodedetailed"].select("owner", "name", "nr_lines").collect() == [("SCOTT", "P", 7)]
    with pytest.raises(ValueError):
        ora_objects(mine, "o", scope="user")
    with pytest.raises(ValueError):
        ora_objects(mine, "o", scope="root")


def test_oracle_columns(ora):
    (row,) = ora_columns(ora, "o", ordered=True).collect()
    assert row.asDict() == {
        "pkey": "o", "con_id": 1, "owner": "APP", "table_name": "T1", "column_name": "C", "data_type": "NUMBER",
        "data_length": 22, "data_precision": 10, "data_scale": 2, "nullable": "Y", "dma_source_id": "Oracle", "dma_manual_id": None,
    }


def test_every_normaliser_fills_the_staged_schema(pg, ora):
    for staged in (normalize_postgres(pg, "p"), normalize_oracle(ora, "o")):
        for table, rows in staged.items():
            want = [(f.name, f.dataType) for f in STAGED[table]]
            assert [(f.name, f.dataType) for f in rows.schema] == want


def test_supplied_tables_and_rollup(spark):
    grants = spark.createDataFrame([("U", "R")], "GRANTEE string, GRANTED_ROLE string")
    (row,) = supplied(grants, "roleprivs", "o", "Oracle").collect()
    assert (row["pkey"], row["grantee"], row["granted_role"], row["con_id"]) == ("o", "U", "R", 1)
    with pytest.raises(ValueError):
        supplied(grants, "columns")
    lines = spark.createDataFrame([("o", "S", "F", 2_000_000_000), ("o", "S", "F", 2_000_000_000)], "pkey string, owner string, type string, nr_lines int")
    assert sourcecode_rollup(lines).collect()[0]["sum_nr_lines"] == 4_000_000_000
