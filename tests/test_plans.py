"""The plans are the ones meant: exchanges, pruning, pushdown, no row-at-a-time code."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from catalogdiff import InstancePairs, Staging, compare, stage
from catalogdiff.operators import TwoInstances, column_drift, ora_source_lines, pg_source_lines, presence_diff
from catalogdiff.plans import SECTIONS
from catalogdiff.verify.queries import ORA_VIEWS, PG_VIEWS, SRC, STAGED_VIEWS, TGT, frames

OBJECT = ("owner", "object_name", "object_type")


@pytest.fixture(scope="module")
def staging(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("staging"))
    stage(frames(spark, sf_dir, STAGED_VIEWS), path)
    return Staging.open(spark, path)


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    """The plan of the rows: the look-up of the two ids in the list of instances is left out."""
    lines, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if skipped is not None and depth > skipped:
            continue
        skipped = depth if re.match(r"[ :+-]*(Reused)?Subquery", line) else None
        if skipped is None:
            lines.append(line)
    return "\n".join(lines)


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def section(staging, title, **options):
    return compare(staging, instances=(SRC, TGT), sections=[title], **options)[title]


@pytest.mark.parametrize("dedupe", [True, False])
def test_presence_diff_is_one_hash_exchange(staging, dedupe):
    rows = presence_diff(staging["dbobjectnames"], OBJECT, TwoInstances(SRC, TGT), dedupe)
    assert exchanges(rows) == 1
    assert ("REBALANCE" in plan(rows)) is not dedupe
    assert "partial_count" in plan(rows)


@pytest.mark.parametrize("title", [t for t in SECTIONS if t != "Instances"])
def test_sections_have_no_cartesian_python_or_single_task_steps(staging, title):
    text = plan(section(staging, title))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "Python", "MapInPandas"):
        assert bad not in text


def test_counts_and_lines_are_one_exchange(staging):
    assert exchanges(section(staging, "All Object Counts")) == 1
    assert exchanges(section(staging, "Mismatched Line Counts per Object (PL/SQL)")) == 1


def test_missing_columns_uses_an_equi_anti_join(staging):
    text = plan(section(staging, "Missing Columns"))
    assert re.search(r"SortMergeJoin.*LeftAnti", text)


def test_own_instances_prune_the_scan(staging):
    for title in ("Column Type Mismatches", "Mismatched Line Counts per Object (PL/SQL)", "Mismatched Object Counts"):
        assert re.search(r"PartitionFilters: \[.*staged_bucket#\d+ IN", plan(section(staging, title)))
    pruned = plan(section(staging, "Missing Objects", universe="pair"))
    assert re.search(r"PartitionFilters: \[.*staged_bucket#\d+ IN", pruned) and re.search(r"PushedFilters: \[.*In\(pkey", pruned)
    assert "staged_bucket#" not in plan(section(staging, "Missing Objects")).split("PartitionFilters")[1].split("]")[0]


def test_owner_filter_and_columns_reach_the_scan(staging):
    text = plan(section(staging, "Missing Objects", owners=["SCH_3"]))
    assert "EqualTo(owner,SCH_3)" in text or "In(owner" in text
    assert "dma_source_id" not in text


def test_pairs_are_broadcast_not_rows(spark, staging):
    rows = presence_diff(staging["dbobjectnames"], OBJECT, InstancePairs.of(spark, [(SRC, TGT)]))
    text = plan(rows)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def written_rows(df) -> list[int]:
    """Rows that each exchange of the executed plan wrote, the small ones of the pairs themselves left out."""
    df.collect()
    sizes = []
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if name == "Exchange" and "object_name" in node.simpleString(1000):
            sizes.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sizes


def test_rows_of_one_database_against_many_are_not_multiplied(spark, sf_dir):
    """1, 2 and 8 pairs of one database with copies of another: the largest exchange is that of the staged rows."""
    one, two = (frames(spark, sf_dir, {"o": "fx_dbobjectnames"})["o"].where(F.col("pkey") == p).cache() for p in (SRC, TGT))
    most = []
    for n in (2, 8):
        copies = two.withColumn("pkey", F.explode(F.array(*[F.lit(f"copy_{i}") for i in range(n)])))
        rows = one.unionByName(copies)
        found = presence_diff(rows, OBJECT, InstancePairs.of(spark, [(SRC, f"copy_{i}") for i in range(n)]), dedupe=True)
        sizes = written_rows(found)
        most.append(max(sizes) / (one.count() + n * two.count()))
    # Rows times pairs would be 1.5 and 1.8 of these.
    assert max(most) <= 1


def test_a_report_scans_each_table_once(spark, staging):
    """Counts, their mismatches, missing objects and the tables missing columns are held against: one aggregate."""
    report = compare(staging, instances=(SRC, TGT), sections=[t for t in SECTIONS if "Object" in t and "PL/SQL" not in t] + ["Missing Columns"])
    findings = report.findings()
    findings.collect()
    text = plan(findings)
    executed = text[text.index("Final Plan") : text.index("Initial Plan")]
    scans = [s for s in re.findall(r"FileScan parquet \[[^\]]*\]", executed) if "object_name" in s]
    assert len(scans) == 1
    assert executed.count("ReusedExchange") >= 5


def test_named_ids_start_no_job_while_a_report_is_built(spark, staging):
    def jobs():
        return len(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup("building"))

    spark.sparkContext.setJobGroup("building", "building")
    try:
        compare(staging, instances=(SRC, TGT), sections=list(SECTIONS))
        compare(staging, pairs=[(SRC, TGT), (SRC, "zz_third")], sections=list(SECTIONS))
        assert jobs() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_definitions_are_not_shuffled(spark, sf_dir):
    text = plan(pg_source_lines(frames(spark, sf_dir, PG_VIEWS), TGT))
    for line in re.findall(r"Exchange .*", text):
        assert "definition" not in line and "text" not in line
    # Counted next to the scan, below the first join.
    assert "replace(" in text and text.index("replace(") > text.index("Join")


def test_source_lines_combine_before_the_exchange(spark, sf_dir):
    text = plan(ora_source_lines(frames(spark, sf_dir, ORA_VIEWS), SRC))
    assert "partial_max" in text


def test_report_counts_share_an_exchange(staging):
    titles = [t for t in SECTIONS if "Object Counts" in t]
    report = compare(staging, instances=(SRC, TGT), sections=titles)
    findings = report.findings()
    findings.collect()
    final = plan(findings)
    assert final.count("ReusedExchange") >= 3


@pytest.fixture
def small_skew(spark):
    """Skew handling at the size of a test."""
    conf = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_columns(spark):
    """A third of side 1's columns are of one table; half of those are on side 2 too."""
    return spark.range(0, 60_000, 1, 8).selectExpr(
        "explode(if(id % 2 = 0, array('a', 'b'), array('a'))) AS pkey",
        "'S' AS owner",
        "if(id % 3 = 0, 'hot', concat('t', id % 5000)) AS table_name",
        "concat('c', if(id % 3 = 0, id, id div 5000)) AS column_name",
    )


def test_a_hot_table_is_split_in_the_anti_join(spark, small_skew, tmp_path):
    hot_columns(spark).write.partitionBy("pkey").parquet(str(tmp_path / "c"))
    columns = spark.read.parquet(str(tmp_path / "c"))
    gone = spark.range(5000).selectExpr("'S' AS owner", "concat('t', id) AS object_name")
    missing = presence_diff(
        columns,
        ("owner", "table_name", "column_name"),
        TwoInstances("a", "b"),
        unless=gone,
        unless_on=[("owner", "owner"), ("table_name", "object_name")],
    )
    rows = missing.collect()
    assert {r["table_name"] for r in rows} == {"hot"} and len(rows) == 10_000
    assert "skew=true" in plan(missing)


DECLARED = ("1 AS data_length", "1 AS data_precision", "0 AS data_scale", "'Y' AS nullable")


def test_a_hot_column_is_split_in_the_drift_join(spark, small_skew, tmp_path):
    rows = spark.range(0, 90_000, 1, 8).selectExpr(
        "if(id % 3 = 0 OR id % 2 = 0, 'a', 'b') AS pkey",
        "'S' AS owner",
        "if(id % 3 = 0, 'hot', concat('t', id div 2)) AS table_name",
        "'c' AS column_name",
        "if(id % 3 = 0 OR id % 2 = 0, concat('T', id), 'NUMBER') AS data_type",
        *DECLARED,
    )
    extra = spark.range(1).selectExpr(
        "'b' AS pkey", "'S' AS owner", "'hot' AS table_name", "'c' AS column_name", "'NUMBER' AS data_type", *DECLARED
    )
    rows.unionByName(extra).write.partitionBy("pkey").parquet(str(tmp_path / "c"))
    drift = column_drift(spark.read.parquet(str(tmp_path / "c")), TwoInstances("a", "b"))
    found = drift.collect()
    assert sum(r["table_name"] == "hot" for r in found) == 30_000
    assert "skew=true" in plan(drift)
