"""Extract files, staging, and the text of JDBC reads (no database is started)."""

from __future__ import annotations

import csv
import os

import pytest

from catalogdiff import Staging, import_extracts, stage
from catalogdiff.schemas import STAGED, conform
from catalogdiff.sources import read_extracts, read_staged, write_extract, write_staged
from catalogdiff.sources.jdbc import ORACLE, POSTGRES, catalog_query, default_tables, read_predicates

NAMES = STAGED["dbobjectnames"].names


def extract(folder, name, rows, header=NAMES):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        writer = csv.writer(f, delimiter="|")
        writer.writerow(header)
        writer.writerows(rows)


def row(pkey, name):
    return (pkey, 1, "S", name, "TABLE", "Oracle", None)


AWKWARD = ["NA", "NULL", "a|b", 'say "x"', "two\nlines", " padded ", "back\\slash", "ünïcode", "#hash"]


def test_awkward_names_are_read_as_written(spark, tmp_path):
    folder = str(tmp_path / "x")
    extract(folder, "host_orcl__dbobjectnames__data.csv", [row("o", n) for n in AWKWARD], [n.upper() for n in NAMES])
    got = read_extracts(spark, folder, "dbobjectnames")
    assert sorted(r["object_name"] for r in got.collect()) == sorted(AWKWARD)
    assert got.where("dma_manual_id is not null").count() == 0


def test_files_are_routed_by_name(spark, tmp_path):
    folder = str(tmp_path / "x")
    extract(folder, "orcl__dbobjectnames__data.csv", [row("o", "kept")])
    extract(folder, "pgdb__dbobjectnames__data.csv", [row("p", "kept")])
    extract(folder, "orcl__dbobjectnames__eoj.csv", [row("o", "skipped")])
    extract(folder, "orcl__other__dbobjectnames__data.csv", [row("o", "other table")])
    got = read_extracts(spark, folder, "dbobjectnames").collect()
    assert sorted((r["pkey"], r["object_name"]) for r in got) == [("o", "kept"), ("p", "kept")]


def test_bad_records_and_headers_fail(spark, tmp_path):
    short = str(tmp_path / "short")
    extract(short, "a__dbobjectnames__data.csv", [("o", "not a number", "S", "T", "TABLE", "x", None)])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CAST|not a number"):
        read_extracts(spark, short, "dbobjectnames").collect()
    swapped = str(tmp_path / "swapped")
    extract(swapped, "a__dbobjectnames__data.csv", [row("o", "x")], [NAMES[1], NAMES[0], *NAMES[2:]])
    with pytest.raises(Exception, match="(?i)header"):
        read_extracts(spark, swapped, "dbobjectnames").collect()


def test_splittable_reads_agree_or_fail(spark, tmp_path):
    plain, broken = str(tmp_path / "plain"), str(tmp_path / "broken")
    extract(plain, "a__dbobjectnames__data.csv", [row("o", f"n{i}") for i in range(50)])
    assert read_extracts(spark, plain, "dbobjectnames", splittable=True).count() == 50
    extract(broken, "a__dbobjectnames__data.csv", [row("o", "two\nlines")])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_extracts(spark, broken, "dbobjectnames", splittable=True).collect()


def test_written_extracts_read_back(spark, tmp_path):
    """All but empty text, which an extract cannot tell from NULL."""
    rows = spark.createDataFrame([row("o", n) for n in [*AWKWARD, "", None]], STAGED["dbobjectnames"])
    write_extract(rows, str(tmp_path), "dbobjectnames")
    got = [r["object_name"] for r in read_extracts(spark, str(tmp_path), "dbobjectnames").collect()]
    assert sorted(got, key=repr) == sorted([*AWKWARD, None, None], key=repr)


def objects(spark, *rows):
    return spark.createDataFrame([row(*r) for r in rows], STAGED["dbobjectnames"])


def test_restaging_one_instance_leaves_the_other(spark, tmp_path):
    path = str(tmp_path)
    write_staged(objects(spark, ("a", "x"), ("a", "y"), ("b", "z")), path, "dbobjectnames")
    write_staged(objects(spark, ("a", "w")), path, "dbobjectnames")
    got = sorted((r["pkey"], r["object_name"]) for r in read_staged(spark, path, "dbobjectnames").collect())
    assert got == [("a", "w"), ("b", "z")]


def test_instance_ids_stay_text(spark, tmp_path):
    path = str(tmp_path)
    write_staged(objects(spark, ("007", "x"), ("a/b c=d", "y")), path, "dbobjectnames")
    got = read_staged(spark, path, "dbobjectnames")
    assert got.columns == NAMES
    assert sorted(r["pkey"] for r in got.collect()) == ["007", "a/b c=d"]


def test_import_loads_what_is_there(spark, tmp_path):
    folder, path = str(tmp_path / "x"), str(tmp_path / "s")
    extract(folder, "orcl__dbobjectnames__data.csv", [row("o", "x")])
    extract(folder, "orcl__instances__data.csv", [("o", 1)], ["PKEY", "CON_ID"])
    assert import_extracts(spark, folder, path) == ["instances", "dbobjectnames"]
    staging = Staging.open(spark, path)
    assert staging["dbobjectnames"].count() == staging["instances"].count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        import_extracts(spark, folder, path, ["views"])


def test_extracts_of_other_tables_are_staged_as_text(spark, tmp_path):
    folder, path = str(tmp_path / "x"), str(tmp_path / "s")
    extract(folder, "a__mine__data.csv", [("007", "01", "x|y"), ("b", None, "NA")], ["PKEY", "N", "odd `name`"])
    extract(folder, "b__mine__data.csv", [("c", "3", "z")], ["PKEY", "N", "odd `name`"])
    extract(folder, "a__mine__eoj.csv", [("skipped",)], ["done"])
    extract(folder, "a__plain__data.csv", [("1",)], ["n"])
    extract(folder, "a__views__data.csv", [("o", 1, "S", "V", None, None)], STAGED["views"].names)
    assert import_extracts(spark, folder, path) == ["views", "mine", "plain"]
    import_extracts(spark, folder, path)
    staging = Staging.open(spark, path)
    rows = sorted(tuple(r) for r in staging["mine"].select("pkey", "N", "`odd ``name```").collect())
    assert rows == [("007", "01", "x|y"), ("b", None, "NA"), ("c", "3", "z")]
    assert [tuple(r) for r in staging["plain"].collect()] == [("1",)] and staging["views"].count() == 1
    with pytest.raises(KeyError):
        staging["nothing"]
    with pytest.raises(KeyError):
        Staging.open(spark, path, ["views"])["mine"]


def test_extracts_of_another_table_agree_in_their_header(spark, tmp_path):
    extract(str(tmp_path / "x"), "a__mine__data.csv", [("o", "1")], ["pkey", "n"])
    extract(str(tmp_path / "x"), "b__mine__data.csv", [("o", "1")], ["pkey", "m"])
    with pytest.raises(Exception, match="(?i)header"):
        import_extracts(spark, str(tmp_path / "x"), str(tmp_path / "s"))


def test_staging_derives_sourcecode(spark, tmp_path):
    lines = spark.createDataFrame([("o", 1, "S", "f", "FUNCTION", 3), ("o", 1, "S", "g", "FUNCTION", 4)],
                                  "pkey string, con_id int, owner string, name string, type string, nr_lines int")
    stage({"sourcecodedetailed": conform(lines, "sourcecodedetailed")}, str(tmp_path))
    for staging in (Staging.open(spark, str(tmp_path)), Staging({"sourcecodedetailed": lines})):
        assert [r["sum_nr_lines"] for r in staging["sourcecode"].collect()] == [7]
    with pytest.raises(KeyError):
        Staging({})["views"]


def test_catalog_queries():
    query, spread = catalog_query("postgres", "pg_class")
    assert query.startswith("(SELECT oid::bigint AS oid") and query.endswith("FROM pg_class) t") and spread == "relname"
    assert catalog_query("oracle", "objects", "all")[0].endswith("FROM all_objects) t")
    assert catalog_query("oracle", "tab_partitions", "user")[0] == "(SELECT table_name FROM user_tab_partitions) t"
    assert catalog_query("oracle", "indexes", "user")[0].startswith("(SELECT index_name, index_type, table_owner,")
    assert catalog_query("oracle", "role_privs", "all")[0].endswith("FROM dba_role_privs) t")
    assert catalog_query("oracle", "role_privs", "user")[0] == "(SELECT username AS grantee, granted_role FROM user_role_privs) t"
    for bad in (("mysql", "x"), ("oracle", "objects", "root")):
        with pytest.raises(ValueError):
            catalog_query(*bad)


@pytest.mark.parametrize("dialect,tables", [("oracle", ORACLE), ("postgres", POSTGRES)])
def test_reads_are_spread_by_a_selected_column(dialect, tables):
    for table in tables:
        query, spread = catalog_query(dialect, table)
        predicates = read_predicates(dialect, spread, 4)
        assert len(set(predicates)) == 4
        assert spread.partition("::")[0] in query


def test_grants_and_indexes_are_read_on_request():
    assert set(ORACLE) - set(default_tables("oracle")) == {"indexes", "role_privs", "sys_privs"}
    assert default_tables("postgres") == list(POSTGRES)


def test_tables_are_told_from_names_and_folders_without_a_pattern(spark, tmp_path):
    """The name is looked at for each row, so it is cut, not searched."""
    folder = str(tmp_path / "x")
    extract(folder, "a___b__dbobjectnames__data.csv", [row("o", "another table")])
    extract(folder, "a__dbobjectnames__part-1.csv", [row("o", "file")])
    extract(folder + "/b__dbobjectnames__data.csv", "part-00000-x.csv", [row("o", "part")])
    extract(folder + "/b__dbobjectnames__eoj.csv", "part-00000-x.csv", [row("o", "skipped")])
    got = read_extracts(spark, folder, "dbobjectnames")
    assert sorted(r["object_name"] for r in got.collect()) == ["file", "part"]
    assert "regexp" not in got._jdf.queryExecution().executedPlan().toString()
