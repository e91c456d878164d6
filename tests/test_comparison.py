"""Comparison semantics on hand-made snapshots, and against brute force on random ones."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogdiff import InstancePairs, Staging, TwoInstances, compare
from catalogdiff.operators import column_drift, count_diff, line_diff, presence_diff
from catalogdiff.operators.copies import repeat_rows
from catalogdiff.operators.counts import mapped_count_diff
from catalogdiff.operators.presence import mapped_presence_diff
from tests.conftest import bag

SIDES = TwoInstances("a", "b")
OBJECT = ("owner", "object_name", "object_type")
OBJECTS = "pkey string, owner string, object_name string, object_type string"
COLUMNS = (
    "pkey string, owner string, table_name string, column_name string, data_type string,"
    " data_length int, data_precision int, data_scale int, nullable string"
)


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), OBJECTS)


def brute_presence(rows, one, two, universe):
    """Universe left joined to each side, row by row."""
    out = Counter()
    for key in {r[1:] for r in rows if r[0] in universe}:
        n = [sum(r[0] == side and r[1:] == key and None not in key for r in rows) for side in (one, two)]
        if 0 in n:
            status = tuple("Present" if k else "Missing" for k in n)
            out[key + status] += max(*n, 1)
    return out


def random_rows(seed, instances=("a", "b", "c")):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [
        (pick(*instances), pick("S", "T", None), pick("x", "y", "z", None), pick("TABLE", "VIEW", None))
        for _ in range(rng.randint(0, 60))
    ]


@pytest.mark.parametrize("seed", range(6))
def test_presence_diff_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    got = Counter(tuple(r) for r in presence_diff(objects(spark, *rows), OBJECT, SIDES).collect())
    assert got == brute_presence(rows, "a", "b", {"a", "b", "c"})


@pytest.mark.parametrize("seed", range(4))
def test_many_pairs_equal_brute_force_per_pair(spark, seed):
    rows = random_rows(seed)
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    found = presence_diff(objects(spark, *rows), OBJECT, InstancePairs.of(spark, pairs))
    got = Counter(tuple(r) for r in found.collect())
    want = Counter()
    for one, two in pairs:
        for row, n in brute_presence(rows, one, two, {one, two}).items():
            want[(f"{one}|{two}", *row)] += n
    assert got == want


def test_diff_of_equal_snapshots_is_empty(spark):
    rows = [(p, "S", f"o{i}", "TABLE") for p in "ab" for i in range(20)]
    assert presence_diff(objects(spark, *rows), OBJECT, SIDES).count() == 0


def test_swapping_sides_swaps_statuses(spark):
    rows = objects(spark, *random_rows(11))
    there = bag(presence_diff(rows, OBJECT, SIDES))
    back = bag(presence_diff(rows, OBJECT, TwoInstances("b", "a")))
    assert there == back


def test_null_key_is_missing_on_both_sides_once(spark):
    rows = objects(spark, ("a", "S", "x", None), ("a", "S", "x", None), ("b", "S", "x", None))
    assert bag(presence_diff(rows, OBJECT, SIDES)) == [("Missing", "Missing", "x", None, "S")]


def test_third_instance_key_is_missing_on_both_sides_unless_left_out(spark):
    rows = objects(spark, ("c", "S", "x", "TABLE"))
    assert presence_diff(rows, OBJECT, SIDES).count() == 1
    assert presence_diff(rows, OBJECT, TwoInstances("a", "b", "pair")).count() == 0


def test_present_side_repeats_and_dedupe_collapses(spark):
    rows = objects(spark, *[("a", "S", "f", "FUNCTION")] * 3)
    assert presence_diff(rows, OBJECT, SIDES).count() == 3
    assert presence_diff(rows, OBJECT, SIDES, dedupe=True).count() == 1


@pytest.mark.parametrize("spread,order", [(True, ()), (False, ()), (True, ("id",))])
def test_repeat_rows_keeps_every_copy(spark, spread, order):
    counts = [1, 2, 999, 1000, 1001, 2500, 1_000_000, 1_000_001]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "id int, n bigint")
    got = {r["id"]: r["count"] for r in repeat_rows(df, "n", spread, order).groupBy("id").count().collect()}
    assert got == dict(enumerate(counts))


def test_copies_of_one_row_are_cut_apart_by_a_sort(spark):
    df = spark.createDataFrame([("hot", 3_000_000), ("z", 1)], "id string, n bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = repeat_rows(df, "n", order=("id",)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in sizes) == 3_000_001 and len(sizes) > 2


def test_hot_key_is_counted_not_collected(spark):
    """One key holds most rows of one side; its findings come back whole."""
    hot = spark.range(300_000).select(F.lit("a").alias("pkey"), F.lit("S").alias("owner"),
                                      F.lit("hot").alias("object_name"), F.lit("FUNCTION").alias("object_type"))
    cold = objects(spark, *[("b", "S", f"o{i}", "TABLE") for i in range(10)])
    got = presence_diff(hot.unionByName(cold), OBJECT, SIDES).groupBy("object_name").count().collect()
    assert {r["object_name"]: r["count"] for r in got} == {"hot": 300_000, **{f"o{i}": 1 for i in range(10)}}


def drift_rows(seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [
        (pick("a", "b", "c"), pick("S", None), "T", pick("x", "y", None), pick("NUMBER", "DATE", None),
         pick(1, 2, None), pick(1, None), pick(0, 1), pick("Y", "N", None))
        for _ in range(40)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_drift_equals_nested_loop(spark, seed):
    rows = drift_rows(seed)
    want = Counter()
    for x in rows:
        for y in rows:
            same = x[0] == "a" and y[0] == "b" and None not in x[1:4] and x[1:4] == y[1:4]
            if same and any(p is not None and q is not None and p != q for p, q in zip(x[4:], y[4:], strict=True)):
                want[x[1:4] + (x[4], y[4], x[5], y[5], x[6], y[6], x[8], y[8])] += 1
    got = Counter(tuple(r) for r in column_drift(spark.createDataFrame(rows, COLUMNS), SIDES).collect())
    assert got == want
    deduped = column_drift(spark.createDataFrame(rows, COLUMNS), SIDES, dedupe=True)
    assert {tuple(r) for r in deduped.collect()} == set(want)


def test_drift_of_a_column_staged_many_times_does_not_pair_rows(spark):
    """2,000 equal rows a side make 4 million pairs, none of which differ."""
    row = ("S", "T", "x", "NUMBER", 1, 1, 0, "Y")
    rows = [(p, *row) for p in "ab" for _ in range(2000)]
    assert column_drift(spark.createDataFrame(rows, COLUMNS), SIDES).count() == 0


def test_scale_alone_is_a_difference_and_null_is_none(spark):
    base = ("S", "T", "x", "NUMBER", 1, 1)
    scale = [("a", *base, 0, "Y"), ("b", *base, 2, "Y")]
    null = [("a", *base, 0, "Y"), ("b", *base, None, "Y")]
    assert column_drift(spark.createDataFrame(scale, COLUMNS), SIDES).count() == 1
    assert column_drift(spark.createDataFrame(null, COLUMNS), SIDES).count() == 0


def test_counts_and_their_mismatches(spark):
    rows = objects(spark, *random_rows(3))
    both = count_diff(rows, ("owner", "object_type"), SIDES)
    unequal = count_diff(rows, ("owner", "object_type"), SIDES, mismatch=True)
    assert bag(unequal) == [r for r in bag(both) if r[0] != r[1]]
    assert sum(r["a_count"] for r in both.collect()) == rows.where("pkey = 'a'").count()


def test_line_counts_need_both_sides(spark):
    rows = spark.createDataFrame(
        [("a", "S", "f", 3), ("b", "S", "f", 4), ("b", "S", "f", 2), ("a", "S", "g", 1), ("c", "S", "g", 9)],
        "pkey string, owner string, name string, nr_lines int",
    )
    assert bag(line_diff(rows, ("owner", "name"), "nr_lines", SIDES)) == [(3, 4, "f", "S")]


def test_mapped_diff_ignores_other_owners(spark):
    rows = objects(
        spark,
        ("a", "SRC", "x", "TABLE"), ("a", "SRC", "y", "TABLE"), ("b", "TGT", "x", "TABLE"),
        ("b", "OTHER", "y", "TABLE"), ("c", "SRC", "z", "TABLE"), ("b", "TGT", None, "VIEW"),
    )
    got = mapped_presence_diff(rows, OBJECT[1:], SIDES, [("SRC", "TGT")])
    assert sorted(map(tuple, got.collect()), key=repr) == [
        ("SRC", "y", "TABLE", "Present", "Missing"),
        ("TGT", None, "VIEW", "Missing", "Missing"),
    ]


def test_mapped_counts_keep_null_types_apart(spark):
    rows = objects(spark, ("a", "SRC", "x", None), ("b", "TGT", "x", None), ("b", "TGT", "y", "VIEW"))
    got = mapped_count_diff(rows, "object_type", SIDES, [("SRC", "TGT")])
    assert sorted(map(tuple, got.collect()), key=repr) == [("VIEW", 0, 1), (None, 0, 1), (None, 1, 0)]


def staging(spark, objects_rows, column_rows):
    return Staging(
        {
            "instances": spark.createDataFrame([("a", 1), ("b", 1)], "pkey string, con_id int"),
            "dbobjectnames": objects(spark, *objects_rows),
            "columns": spark.createDataFrame([r + ("NUMBER", 1, 1, 0, "Y") for r in column_rows], COLUMNS),
        }
    )


def test_columns_of_missing_tables_are_left_out_but_not_of_missing_views(spark):
    staged = staging(
        spark,
        [("a", "S", "T1", "TABLE"), ("a", "S", "V1", "VIEW"), ("a", "S", "T2", "TABLE"),
         ("b", "S", "T2", "PARTITIONED TABLE"), ("a", "S", "T3", "TABLE"), ("b", "S", "T3", "TABLE")],
        [("a", "S", "T1", "c"), ("a", "S", "V1", "c"), ("a", "S", "T2", "c"), ("a", "S", "T3", "c"),
         ("c", "S", "T3", "unlisted")],
    )
    got = compare(staged, sections=["Missing Columns"])["Missing Columns"]
    assert {r["table_name"] for r in got.collect()} == {"V1", "T3"}


def test_null_owner_of_a_missing_table_hides_nothing(spark):
    staged = staging(spark, [("a", None, "T1", "TABLE")], [("a", "S", "T1", "c")])
    assert compare(staged, sections=["Missing Columns"])["Missing Columns"].count() == 1
