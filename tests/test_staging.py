"""Loads replace instances whole and at once, files are bounded, and reads prune."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from catalogdiff import Staging, compare, import_extracts, stage
from catalogdiff.operators import selection
from catalogdiff.schemas import STAGED, conform
from catalogdiff.sources import compact, read_staged, staging, superseded, write_extract, write_staged
from catalogdiff.sources.staging import BUCKETS, Manifest


def instances(spark, *ids):
    return conform(spark.createDataFrame([(i,) for i in ids], "pkey string"), "instances")


def views(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "pkey string, owner string, view_name string"), "views")


def seen(spark, path, table="views"):
    return sorted((r["pkey"], r["view_name"]) for r in read_staged(spark, path, table).collect())


def test_a_table_that_is_now_empty_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path)
    stage({"instances": instances(spark, "a", "b"), "views": views(spark, ("a", "S", "V1"), ("b", "S", "V2"))}, path)
    stage({"instances": instances(spark, "a"), "views": views(spark)}, path)
    assert seen(spark, path) == [("b", "V2")]
    assert sorted(r["pkey"] for r in read_staged(spark, path, "instances").collect()) == ["a", "b"]
    # A single table names its instances by its rows, or they are named.
    write_staged(views(spark), path, "views")
    assert seen(spark, path) == [("b", "V2")]
    write_staged(views(spark), path, "views", instances=["b"])
    assert seen(spark, path) == []


def test_tables_that_a_load_does_not_give_stay_unless_it_is_whole(spark, tmp_path):
    path = str(tmp_path)
    stage({"instances": instances(spark, "a", "b"), "views": views(spark, ("a", "S", "V1"), ("b", "S", "V2"))}, path)
    stage({"instances": instances(spark, "a")}, path)
    assert seen(spark, path) == [("a", "V1"), ("b", "V2")]
    stage({"instances": instances(spark, "a")}, path, whole=True)
    assert seen(spark, path) == [("b", "V2")]


def test_a_load_that_fails_between_two_tables_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    first = {"instances": instances(spark, "a"), "views": views(spark, ("a", "S", "V1"))}
    stage(first, path)
    broken = views(spark, ("a", "S", "V2")).withColumn("view_name", F.expr("CAST(raise_error('cut') AS string)"))
    for tables in ({"instances": instances(spark, "a", "new"), "views": broken}, {"views": views(spark, ("", "S", "V3"))}):
        with pytest.raises(Exception, match="cut|no pkey"):
            stage(tables, path)
        assert seen(spark, path) == [("a", "V1")]
        assert [r["pkey"] for r in read_staged(spark, path, "instances").collect()] == ["a"]
    # What was written before the failure is there, and no reader looks at it.
    assert len(glob.glob(f"{path}/instances/staged_version=*")) == 2
    stage(first, path)
    assert seen(spark, path) == [("a", "V1")]


def test_an_open_staging_does_not_see_later_loads(spark, tmp_path):
    path = str(tmp_path)
    stage({"instances": instances(spark, "a"), "views": views(spark, ("a", "S", "V1"))}, path)
    opened = Staging.open(spark, path)
    assert opened["instances"].count() == 1
    stage({"instances": instances(spark, "a", "b"), "views": views(spark, ("a", "S", "V2"))}, path)
    assert [r["view_name"] for r in opened["views"].collect()] == ["V1"]
    assert [r["view_name"] for r in Staging.open(spark, path)["views"].collect()] == ["V2"]


def test_of_loads_of_one_instance_the_one_done_last_counts(spark, tmp_path):
    path = str(tmp_path)
    for at, name in (("2", "second"), ("1", "first"), ("3", "third")):
        stage({"views": views(spark, ("a", "S", name), (f"only_{at}", "S", name))}, path, at=at)
    assert seen(spark, path) == [("a", "third"), ("only_1", "first"), ("only_2", "second"), ("only_3", "third")]


def many(spark, n):
    return conform(spark.range(n).selectExpr("concat('db', id) AS pkey", "'S' AS owner", "concat('V', id) AS view_name"), "views")


def test_files_are_bounded_by_buckets_not_instances(spark, tmp_path):
    path = str(tmp_path)
    write_staged(many(spark, 2_000), path, "views")
    files = glob.glob(f"{path}/views/*/*/part-*")
    assert BUCKETS <= len(files) <= 2 * BUCKETS
    assert read_staged(spark, path, "views").select("pkey").distinct().count() == 2_000


def test_two_instances_of_a_fleet_prune_buckets_and_row_groups(spark, tmp_path):
    path = str(tmp_path)
    write_staged(many(spark, 2_000), path, "views")
    rows = Staging.open(spark, path).of(["db7", "db1999"])["views"]
    assert sorted(r["view_name"] for r in rows.collect()) == ["V1999", "V7"]
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [staged_bucket" in text.replace("isnotnull(staged_version), ", "") or "staged_bucket#" in text.split("PartitionFilters")[1]
    scan = [n for n in _nodes(rows._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet")][0]
    assert scan.metrics().get("numFiles").get().value() <= 4


def _nodes(plan):
    found = [plan]
    children = plan.children()
    for i in range(children.size()):
        found += _nodes(children.apply(i))
    return found


def test_many_small_loads_become_few_files(spark, tmp_path):
    path = str(tmp_path)
    for i in range(4):
        stage({"instances": instances(spark, f"db{i}"), "views": views(spark, (f"db{i}", "S", f"V{i}"))}, path)
    stage({"instances": instances(spark, "db1"), "views": views(spark)}, path)
    spark.createDataFrame([("1",)], "n string").createOrReplaceTempView("plain")
    stage({"plain": spark.table("plain")}, path)
    before = seen(spark, path)
    compact(spark, path)
    assert seen(spark, path) == before == [("db0", "V0"), ("db2", "V2"), ("db3", "V3")]
    assert read_staged(spark, path, "instances").count() == 4 and read_staged(spark, path, "plain").count() == 1
    current = Manifest.read(spark, path).current("views")
    assert len(set(current.values())) == 1
    assert superseded(spark, path, "views").count() == 5
    # A load that was done while rows were read again goes before what was read.
    stage({"views": views(spark, ("db0", "S", "later"))}, path)
    assert ("db0", "later") in seen(spark, path)


def test_a_large_manifest_gives_the_same_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write_staged(many(spark, 40), path, "views")
    write_staged(views(spark, ("db3", "S", "new")), path, "views")
    write_staged(views(spark), path, "views", instances=["db4"])
    stage({"own": spark.createDataFrame([("x",)], "n string")}, path)
    stage({"own": spark.createDataFrame([("y",)], "n string")}, path)
    want = seen(spark, path)
    assert len(want) == 39 and ("db3", "new") in want
    monkeypatch.setattr(staging, "MAX_IN_LIST", 1)
    assert seen(spark, path) == want
    monkeypatch.setattr(staging, "MAX_HINTED_ROWS", 3)
    monkeypatch.setattr(selection, "MAX_HINTED_ROWS", 3)
    assert Manifest.read(spark, path).known is None
    assert seen(spark, path) == want
    assert [r["n"] for r in read_staged(spark, path, "own").collect()] == ["y"]


def test_an_import_replaces_its_instances_whole(spark, tmp_path):
    folder, path = str(tmp_path / "x"), str(tmp_path / "s")
    os.makedirs(folder)
    write_extract(instances(spark, "a", "b"), folder, "instances")
    write_extract(views(spark, ("a", "S", "V1"), ("b", "S", "V2")), folder, "views")
    assert import_extracts(spark, folder, path) == ["instances", "views"]
    again = str(tmp_path / "again")
    write_extract(instances(spark, "a"), again, "instances")
    assert import_extracts(spark, again, path) == ["instances"]
    assert seen(spark, path) == [("b", "V2")]


def test_a_report_over_a_fleet_reads_two_instances(spark, tmp_path):
    path = str(tmp_path)
    names = STAGED["dbobjectnames"].names[:5]
    objects = spark.range(3_000).selectExpr(
        "concat('db', id % 300) AS pkey", "1 AS con_id", "'S' AS owner", "concat('o', id div 300, if(id % 300 = 8 AND id > 2000, 'x', '')) AS object_name",
        "'VIEW' AS object_type",
    )
    stage({"instances": instances(spark, *(f"db{i}" for i in range(300))), "dbobjectnames": objects.select(*names)}, path)
    report = compare(Staging.open(spark, path), instances=("db7", "db8"), sections=["Missing Objects"], universe="pair")
    found = report["Missing Objects"]
    assert sorted(r["object_name"] for r in found.collect()) == ["o7", "o7x", "o8", "o8x", "o9", "o9x"]
    assert "staged_bucket#" in found._jdf.queryExecution().executedPlan().toString()
