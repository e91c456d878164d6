from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalogdiff import InstancePairs, TwoInstances, compare
from catalogdiff.functions import host_to_instance_id, parse_owner_list, parse_owner_map
from catalogdiff.operators import filter_owners, instance_rank, known_instances, pick_instances
from catalogdiff.operators import selection


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "pkey string")


def test_first_two_instances_in_order(spark):
    assert pick_instances(ids(spark, "z", "a", "m", "a", None)) == ("a", "m")


def test_one_instance_is_not_enough(spark):
    with pytest.raises(ValueError):
        pick_instances(ids(spark, "a", "a"))
    with pytest.raises(ValueError):
        TwoInstances("a", "a")


def test_rank_equals_a_sorted_list(spark):
    names = [f"db_{i * 7919 % 1000:04d}" for i in range(1000)]
    got = {r["instance_id"]: r["rn"] for r in instance_rank(ids(spark, *names, *names)).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names), 1)}


def test_rank_of_few_and_null_ids(spark):
    got = {r["instance_id"]: r["rn"] for r in instance_rank(ids(spark, "b", "a", None)).collect()}
    assert got == {None: 1, "a": 2, "b": 3}
    assert instance_rank(ids(spark).limit(0)).count() == 0


def test_owner_filter_and_its_long_form(spark, monkeypatch):
    rows = spark.createDataFrame([("A",), ("B",), (None,)], "owner string")
    assert filter_owners(rows, None).count() == 3
    assert filter_owners(rows, []).count() == 0
    assert filter_owners(rows, ["A", "A", "x"]).count() == 1
    monkeypatch.setattr(selection, "MAX_IN_LIST", 1)
    assert filter_owners(rows, ["A", "A", "x"]).count() == 1


def test_known_instances_drop_the_rest(spark):
    assert known_instances(ids(spark, "a", "b", None), ids(spark, "a", "a")).count() == 1


def test_pairs_are_hinted_only_up_to_the_bound(spark, monkeypatch):
    rows = ids(spark, "a", "b")
    hint = lambda: "broadcast" in str(InstancePairs.of(spark, [("a", "b"), ("b", "a")]).tag(rows)._jdf.queryExecution().logical()).lower()
    assert hint()
    monkeypatch.setattr(selection, "MAX_HINTED_ROWS", 1)
    assert not hint()
    monkeypatch.setattr(selection, "MAX_HINTED_ROWS", 10)
    monkeypatch.setattr(selection, "MAX_HINTED_BYTES", 3)
    assert not hint()


def test_pairs_of_a_dataframe_are_measured(spark, monkeypatch):
    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "a", "c")], "pair_id string, pkey_1 string, pkey_2 string")
    assert InstancePairs.of(spark, pairs).small
    assert InstancePairs.of(spark, pairs.limit(0)).small
    monkeypatch.setattr(selection, "MAX_HINTED_BYTES", 5)
    assert not InstancePairs.of(spark, pairs).small


def test_listed_pairs_prune_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(p, 1) for p in "abc"], "pkey string, n int")
    rows.write.partitionBy("pkey").parquet(str(tmp_path / "t"))
    tagged = InstancePairs.of(spark, [("a", "b")]).tag(spark.read.parquet(str(tmp_path / "t")))
    assert "PartitionFilters: [pkey#" in tagged._jdf.queryExecution().executedPlan().toString()
    assert tagged.count() == 2


def test_pairs_from_a_dataframe(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "b")], "pair_id int, pkey_1 string, pkey_2 string")
    tagged = InstancePairs.of(spark, pairs).tag(ids(spark, "a", "b", "c"))
    assert sorted(map(tuple, tagged.select("pair_id", "pkey", "side").collect())) == [(1, "a", 1), (1, "b", 2)]
    for wrong in ([(1, "a", "b"), (1, "a", "c")], [(1, "a", "a")], [(1, "a", None)]):
        pairs = spark.createDataFrame(wrong, "pair_id int, pkey_1 string, pkey_2 string")
        with pytest.raises(Exception, match="pair_id names two pairs"):
            InstancePairs.of(spark, pairs).tag(ids(spark, "a", "b", "c")).collect()


def test_pairs_with_bars_in_their_ids(spark):
    found = InstancePairs.of(spark, [("a|b", "c"), ("a", "b|c"), ("a", "b|c")]).pairs.collect()
    assert len(found) == 2 and len({r["pair_id"] for r in found}) == 2


def test_long_owner_lists_keep_the_columns(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("p", "z", 2)], "pkey string, owner string, n int")
    for owners in (["a"], ["a", *(f"o{i}" for i in range(2000))]):
        found = filter_owners(rows, owners)
        assert found.columns == rows.columns and [tuple(r) for r in found.collect()] == [("p", "a", 1)]


def test_names_with_quotes_and_backslashes_are_plain_text(spark):
    names = ["O'Brien", "back\\slash", "x' OR 'a' = 'a", 'dq"', "new\nline", "\\'"]
    rows = spark.createDataFrame([(n, n) for n in [*names, "other"]], "pkey string, owner string")
    for name in names:
        assert [r["owner"] for r in filter_owners(rows, [name]).collect()] == [name]
        tagged = TwoInstances(name, "nobody").tag(rows, own_only=True).collect()
        assert [(r["pkey"], r["side"]) for r in tagged] == [(name, 1)]


def test_owner_texts():
    assert parse_owner_list("A, B ,C") == ["A", "B", "C"]
    assert parse_owner_list("") is None and parse_owner_list(None) is None
    assert parse_owner_map("S1/S2") == [("S1", "S2")]
    assert parse_owner_map(None) is None
    with pytest.raises(ValueError):
        parse_owner_map("S1")


def test_instance_ids_of_hosts(spark):
    hosts = spark.createDataFrame([("db-01.example.com",), ("10.0.0.7",), ("tnsname",)], "host string")
    got = hosts.select(host_to_instance_id(F.col("host"), "oracle"), host_to_instance_id(F.col("host"), "postgres"))
    assert [tuple(r) for r in got.collect()] == [
        ("oracle_dbexamplecom", "postgresdbexamplecom"),
        ("oracle_ip_10_0_0_7", "postgresip_10_0_0_7"),
        ("oracle_tnsname", "postgrestnsname"),
    ]


def test_compare_rejects_contradictions(spark):
    staged = {"instances": ids(spark, "a", "b")}
    with pytest.raises(ValueError):
        compare(staged, instances=("a", "b"), pairs=[("a", "b")])
    with pytest.raises(ValueError):
        compare(staged, sections=["No Such Section"])
