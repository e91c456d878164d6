"""Many pairs in one job, against each pair on its own."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogdiff import InstancePairs, Staging, TwoInstances, compare
from catalogdiff.operators import column_drift, count_diff, line_diff, mapped_presence_diff, presence_diff
from catalogdiff.operators.presence import presence_diff_by_variant
from catalogdiff.plans import custom_section
from catalogdiff.schemas import STAGED
from conftest import bag

IDS = [f"db{i}" for i in range(140)]
KEYS = ("owner", "name")
SCHEMA = "pkey string, owner string, name string, kind string, lines int"


def rows_of(spark, seed, ids, n=300, odd=True):
    rng = random.Random(seed)
    owners = ["A", "B", None] if odd else ["A", "B"]
    rows = [
        (rng.choice(ids), rng.choice(owners), rng.choice("pqrst" + ("" if odd else "u")), rng.choice(["X", "Y", "LOB", None]), rng.choice([1, 2, 3, None]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def of_each(build, pairs, values):
    """Rows of ``build(sides)`` pair by pair, with the pair in front."""
    want = Counter()
    for a, b in pairs:
        found = build(TwoInstances(a, b, universe="pair"))
        named = [c for c in found.columns if not c.startswith((f"{a}_", f"{b}_"))]
        shown = [f"{i}_{v}" for v in values for i in (a, b)]
        for row in found.collect():
            want[(f"{a}|{b}", *(row[c] for c in named), *(row[c] for c in shown))] += 1
    return want


def of_all(build, sides, values):
    found = build(sides)
    shown = [f"{v}_{i}" for v in values for i in (1, 2)]
    named = [c for c in found.columns if c != "pair_id" and c not in shown]
    return Counter((r["pair_id"], *(r[c] for c in named), *(r[c] for c in shown)) for r in found.collect())


FORMS = {
    "presence": (lambda rows: lambda s: presence_diff(rows, KEYS, s), ["status"]),
    "presence deduped": (lambda rows: lambda s: presence_diff(rows, KEYS, s, dedupe=True), ["status"]),
    "variants": (lambda rows: lambda s: presence_diff_by_variant(rows, KEYS, "kind", F.col("kind") != "LOB", s), ["status"]),
    "counts": (lambda rows: lambda s: count_diff(rows, KEYS, s), ["count"]),
    "mismatches": (lambda rows: lambda s: count_diff(rows, KEYS, s, mismatch=True), ["count"]),
    "lines": (lambda rows: lambda s: line_diff(rows, KEYS, "lines", s), ["line_count"]),
    "mapped": (lambda rows: lambda s: mapped_presence_diff(rows, ("name", "kind"), s, [("A", "B"), ("B", "B")]), ["status"]),
}


@pytest.mark.parametrize("form", list(FORMS))
@pytest.mark.parametrize("ids,seed", [(IDS[:4], 1), (IDS, 2)])
def test_pairs_equal_each_pair_on_its_own(spark, form, ids, seed):
    make, values = FORMS[form]
    rng = random.Random(seed)
    build = make(rows_of(spark, seed, ids, 60 if len(ids) == 4 else 500).cache())
    star = [(ids[0], i) for i in ids[1:5]]
    pairs = list(dict.fromkeys(star + [tuple(rng.sample(ids, 2)) for _ in range(4)] + [(ids[1], ids[0]), (ids[-1], ids[0])]))
    want = of_each(build, pairs, values)
    assert want
    assert of_all(build, InstancePairs.of(spark, pairs), values) == want
    if len(ids) == 4:
        table = spark.createDataFrame([(f"{a}|{b}", a, b) for a, b in pairs], "pair_id string, pkey_1 string, pkey_2 string")
        assert of_all(build, InstancePairs.of(spark, table), values) == want


@pytest.mark.parametrize("dedupe", [True, False])
def test_drift_of_pairs_equals_each_pair(spark, dedupe):
    rng = random.Random(9)
    ids, pick = IDS[:70], rng.choice
    rows = [
        (pick(ids), "S", pick(["T", None]), pick("xy"), pick(["NUMBER", "DATE", None]), pick([1, 2, None]), pick([1, None]), 0, pick(["Y", "N"]))
        for _ in range(700)
    ]
    schema = "pkey string, owner string, table_name string, column_name string, data_type string, data_length int, data_precision int, data_scale int, nullable string"
    columns = spark.createDataFrame(rows, schema).cache()
    pairs = [(ids[0], i) for i in ids[1:8]] + [(ids[3], ids[2]), (ids[69], ids[1])]
    values = ["data_type", "data_length", "data_precision", "nullable"]
    build = lambda sides: column_drift(columns, sides, dedupe)
    want = of_each(build, pairs, values)
    assert want and of_all(build, InstancePairs.of(spark, pairs), values) == want


def test_copies_are_kept_for_each_pair(spark):
    hot = spark.range(5_000).selectExpr("'ref' AS pkey", "'S' AS owner", "'hot' AS name")
    cold = spark.createDataFrame([(f"db{i}", "S", "hot" if i == 2 else "x") for i in range(4)], "pkey string, owner string, name string")
    found = presence_diff(hot.unionByName(cold), KEYS, InstancePairs.of(spark, [("ref", f"db{i}") for i in range(4)]))
    got = {(r["pair_id"], r["name"]): r["count"] for r in found.groupBy("pair_id", "name").count().collect()}
    assert got == {**{(f"ref|db{i}", "hot"): 5_000 for i in (0, 1, 3)}, **{(f"ref|db{i}", "x"): 1 for i in (0, 1, 3)}}


def staging(spark, ids):
    names = STAGED["dbobjectnames"].names[:5]
    return Staging({
        "instances": spark.createDataFrame([(i, 1) for i in ids], "pkey string, con_id int"),
        "dbobjectnames": spark.createDataFrame([(i, 1, "S", f"o{n % 3}", "VIEW") for n, i in enumerate(ids)], names),
    })


def test_an_instance_that_is_not_staged_fails_whatever_names_it(spark):
    ids = [f"db{i}" for i in range(1_101)]
    staged = staging(spark, ids)
    pairs = list(zip(ids, ids[1:]))
    title = "Missing Objects"
    assert compare(staged, pairs=pairs, sections=[title])[title].count() > 0
    unknown = [*pairs, ("db0", "nobody")]
    table = spark.createDataFrame([(f"{a}|{b}", a, b) for a, b in unknown[-3:]], "pair_id string, pkey_1 string, pkey_2 string")
    for given in (unknown, unknown[-2:], table):
        with pytest.raises(Exception, match="not staged: nobody"):
            compare(staged, pairs=given, sections=[title])[title].collect()
    for universe in ("staged", "pair"):
        with pytest.raises(Exception, match="not staged: nobody"):
            compare(staged, instances=("db1", "nobody"), sections=[title], universe=universe)[title].collect()


def test_custom_sections_group_by_pair(spark):
    staged = staging(spark, ["a", "b", "c"])
    text = "SELECT pair_id, count_if(side = 1) AS n1, count_if(side = 2) AS n2 FROM IDENTIFIER(:dbobjectnames) GROUP BY pair_id"
    report = compare(staged, pairs=[("a", "b"), ("c", "a")], sections=["Missing Objects"], custom={"Mine": text})
    assert sorted(map(tuple, report["Mine"].collect())) == [("a|b", 1, 1), ("c|a", 1, 1)]
    found = report.findings().where("section = 'Mine'").collect()
    assert sorted((r["pair_id"], tuple(sorted(r["key"].items()))) for r in found) == [(p, (("n1", "1"), ("n2", "1"))) for p in ("a|b", "c|a")]
    counts = {(r["pair_id"], r["section"]): r["findings"] for r in report.summary().collect()}
    assert counts == {("a|b", "Mine"): 1, ("c|a", "Mine"): 1, ("a|b", "Missing Objects"): 2, ("c|a", "Missing Objects"): 2}
    for bad in ("SELECT count(*) AS n FROM IDENTIFIER(:dbobjectnames)", "SELECT pair_id FROM <dataset_name>.dbobjectnames WHERE pkey = '<instance_1_id>'"):
        with pytest.raises(ValueError, match="pair"):
            custom_section(bad, report.comparison)


def test_sets_as_columns_and_as_maps_agree(spark, monkeypatch):
    """One instance against 130 others, so that its partners fill three words."""
    ids = [f"i{n}" for n in range(131)]
    rows = spark.range(131 * 40).selectExpr("concat('i', id % 131) AS pkey", "concat('k', id div 131) AS name", "id % 7 AS r").where("r > 0 OR name = 'k1'")
    sides = InstancePairs.of(spark, [(ids[0], i) for i in ids[1:]])
    columns = bag(presence_diff(rows, ("name",), sides))
    monkeypatch.setattr("catalogdiff.operators.pairs.WORDS", 0)
    assert columns == bag(presence_diff(rows, ("name",), sides))
    assert {r[3] for r in columns} | {r[2] for r in columns} == {"Present", "Missing"}


def test_declarations_of_pairs_are_counted_once(spark):
    """What follows the deal by key reads it again instead of counting the declarations anew."""
    rows = spark.range(3000).selectExpr(
        "concat('i', id % 3) AS pkey", "'o' AS owner", "concat('t', id div 9) AS table_name", "concat('c', id div 3 % 3) AS column_name",
        "IF(id % 50 = 0, 'RAW', 'DATE') AS data_type", "1 AS data_length", "1 AS data_precision", "1 AS data_scale", "'Y' AS nullable",
    )
    found = column_drift(rows, InstancePairs.of(spark, [("i0", "i1"), ("i0", "i2")]))
    assert found.count() > 0
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert len(re.findall(r"ReusedExchange|ReusedQueryStage|ResultQueryStage", final)) and len(re.findall(r"Range \(", final)) == 1
