from __future__ import annotations

import pytest

from catalogdiff import Staging, compare, stage, write_findings
from catalogdiff.operators import TwoInstances
from catalogdiff.plans import MAPPED_SECTIONS, SECTIONS, from_template
from catalogdiff.verify.queries import MAPPED_VIEWS, OWNER_MAP, SRC, STAGED_VIEWS, TGT, frames
from tests.conftest import bag


@pytest.fixture(scope="module")
def staging(spark, sf_dir):
    return Staging(frames(spark, sf_dir, STAGED_VIEWS))


def test_default_sections(staging):
    report = compare(staging)
    assert list(report.results) == [
        "Instances", "Mismatched Object Counts", "All Object Counts", "All Object Counts (per Schema)",
        "Mismatched Object Counts (per Schema)", "Missing Objects", "Missing Columns", "Missing PLSQL",
    ]
    assert len(SECTIONS) == 14 and len(MAPPED_SECTIONS) == 5


def test_mapped_run_uses_mapped_sections(spark, sf_dir):
    report = compare(Staging(frames(spark, sf_dir, MAPPED_VIEWS)), owner_maps=OWNER_MAP)
    assert list(report.results) == list(MAPPED_SECTIONS)


def test_written_findings_and_summary(spark, staging, tmp_path):
    titles = ["Missing Objects", "Missing Sys Privileges", "Mismatched Line Counts (PL/SQL)"]
    report = compare(staging, sections=titles, owners=["NOBODY"])
    summary = {r["section"]: r["findings"] for r in write_findings(report, str(tmp_path)).collect()}
    assert summary == {"Missing Objects": 0, "Missing Sys Privileges": 42, "Mismatched Line Counts (PL/SQL)": 0}
    written = spark.read.parquet(f"{tmp_path}/findings")
    assert written.count() == 42
    assert {tuple(sorted(r["key"])) for r in written.collect()} == {("grantee", "privilege")}


def test_nothing_found_still_summarises(spark, staging, tmp_path):
    report = compare(staging, sections=["Missing Objects"], owners=["NOBODY"])
    assert [tuple(r) for r in write_findings(report, str(tmp_path)).collect()] == [(f"{SRC}|{TGT}", "Missing Objects", 0)]


def test_many_pair_summary_lists_every_pair(staging):
    pairs = [(SRC, TGT), (TGT, SRC), (SRC, TGT)]
    report = compare(staging, pairs=pairs, sections=["Instances", "Missing PLSQL"])
    got = {(r["pair_id"], r["section"]): r["findings"] for r in report.summary().collect()}
    assert set(got) == {(None, "Instances"), (f"{SRC}|{TGT}", "Missing PLSQL"), (f"{TGT}|{SRC}", "Missing PLSQL")}
    assert got[None, "Instances"] == 3 and got[f"{SRC}|{TGT}", "Missing PLSQL"] == got[f"{TGT}|{SRC}", "Missing PLSQL"]


def test_pairs_and_ids_that_cannot_be_compared(spark, staging, tmp_path):
    for pairs in ([(TGT, TGT)], [(SRC, None)]):
        with pytest.raises(ValueError):
            compare(staging, pairs=pairs, sections=["Instances"])
    # Whether an id is staged is found out by the query that compares it.
    stage(staging, str(tmp_path))
    staging = Staging.open(spark, str(tmp_path))
    for options in ({"pairs": [(SRC, "nowhere")]}, {"instances": (SRC, "nowhere")}):
        for title in SECTIONS:
            if title != "Instances":
                with pytest.raises(Exception, match="not staged: nowhere"):
                    compare(staging, sections=[title], **options)[title].collect()


def test_custom_sections_are_findings(staging):
    report = compare(staging, sections=["Instances"], custom={"Mine": "SELECT 1 AS one", "None": "SELECT 2 AS two WHERE false"})
    rows = [r for r in report.findings().collect() if r["section"] == "Mine"]
    assert [(r["key"], r["value_1"]) for r in rows] == [({"one": "1"}, None)]
    assert {r["section"]: r["findings"] for r in report.summary().collect()} == {"Instances": 3, "Mine": 1, "None": 0}


def test_many_pairs_agree_with_one_pair(staging):
    title = "Missing Columns"
    many = compare(staging, pairs=[(SRC, TGT)], sections=[title])[title].drop("pair_id")
    one = compare(staging, instances=(SRC, TGT), universe="pair", sections=[title])[title]
    assert bag(many.toDF(*one.columns)) == bag(one)


def test_ordered_sections(staging):
    rows = compare(staging, sections=["Missing Objects"], ordered=True)["Missing Objects"].collect()
    keys = [(r["object_type"] or "", r["object_name"]) for r in rows]
    assert keys == sorted(keys)


@pytest.mark.parametrize("dedupe", [True, False])
def test_ordered_results_hold_the_same_rows(staging, dedupe):
    for title in SECTIONS:
        plain = compare(staging, sections=[title], dedupe=dedupe)[title]
        assert bag(compare(staging, sections=[title], dedupe=dedupe, ordered=True)[title]) == bag(plain)


def test_many_pairs_sort_by_pair_first(staging):
    report = compare(staging, pairs=[(SRC, TGT), (TGT, SRC)], sections=["Instances", "Missing PLSQL"], ordered=True)
    pairs = [r["pair_id"] for r in report["Missing PLSQL"].collect()]
    assert pairs == sorted(pairs) and len(set(pairs)) == 2
    assert report["Instances"].count() == 3


def test_custom_sections_run_with_the_report(staging):
    text = "SELECT owner, :instance_1_id AS one FROM IDENTIFIER(:dbobjectnames) WHERE :all_owners AND pkey = :instance_1_id"
    report = compare(staging, sections=["Instances"], custom={"Mine": text})
    assert report["Mine"].count() == staging["dbobjectnames"].where(f"pkey = '{SRC}'").count()
    with pytest.raises(ValueError):
        compare(staging, pairs=[(SRC, TGT)], sections=[], custom={"Mine": text})


def test_custom_values_are_bound_not_pasted(staging):
    hostile = "x') OR true OR (owner = '"
    text = "SELECT owner FROM IDENTIFIER(:dbobjectnames) a WHERE a.pkey = :instance_1_id AND array_contains(:owners, a.owner)"
    assert compare(staging, sections=[], owners=[hostile], custom={"Mine": text})["Mine"].count() == 0


def test_owner_filters_may_be_text(staging):
    title = "Missing Objects"
    listed = compare(staging, sections=[title], owners=["SCH_3", "SCH_4"])[title]
    assert bag(compare(staging, sections=[title], owners="SCH_3, SCH_4")[title]) == bag(listed)
    assert compare(staging, owner_maps="SCH_3/SCH_4").comparison.owner_maps == [("SCH_3", "SCH_4")]


@pytest.mark.parametrize("mapped", [False, True])
def test_ids_with_odd_characters(spark, sf_dir, mapped):
    odd = {SRC: "10.0.0.7 (dev)", TGT: "db.two-2's"}
    tables = frames(spark, sf_dir, MAPPED_VIEWS if mapped else STAGED_VIEWS)
    renamed = Staging({t: df.replace(odd, subset=["pkey"]) for t, df in tables.items()})
    options = {"owner_maps": OWNER_MAP} if mapped else {}
    sections = list(MAPPED_SECTIONS if mapped else SECTIONS)
    plain = compare(Staging(tables), instances=(SRC, TGT), sections=sections, **options)
    report = compare(renamed, instances=tuple(odd.values()), sections=sections, **options)
    counts = lambda r: {x["section"]: x["findings"] for x in r.summary().collect()}
    assert counts(report) == counts(plain)
    assert "10.0.0.7 (dev)_status" in report["Missing Objects"].columns


def test_template_placeholders():
    text = "SELECT MAX(x) <instance_1_id>_n FROM <dataset_name>.Columns i1 WHERE pkey = '<instance_2_id>' <schema_filter>"
    assert from_template(text, TwoInstances("a`b", "c")) == (
        "SELECT MAX(x) `a``b_n` FROM IDENTIFIER(:columns) i1 WHERE pkey = :instance_2_id"
        " AND (:all_owners OR array_contains(:owners, i1.OWNER))"
    )


def test_template_placeholders_in_text_and_out_of_place():
    sides = TwoInstances("a", "b")
    assert from_template("SELECT 'of <instance_1_id>, <instance_2_id>' -- don't <instance_1_id>\n, 'it''s'", sides) == (
        "SELECT concat('of ', :instance_1_id, ', ', :instance_2_id)  \n, 'it''s'"
    )
    for text in ("SELECT <instance_1_owner>", "SELECT 1 FROM <dataset_name>"):
        with pytest.raises(ValueError, match="placeholder"):
            from_template(text, sides)


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("ids", [("DB", "db"), ("a`b", "a.b c")])
def test_ids_that_differ_in_case_only_or_are_odd(spark, sf_dir, mapped, ids):
    renamed = {SRC: ids[0], TGT: ids[1]}
    plain = frames(spark, sf_dir, MAPPED_VIEWS if mapped else STAGED_VIEWS)
    odd = {t: rows.replace(renamed, subset=["pkey"]) for t, rows in plain.items()}
    options = {"sections": list(MAPPED_SECTIONS if mapped else SECTIONS), "owner_maps": OWNER_MAP if mapped else None}
    want = compare(Staging(plain), instances=(SRC, TGT), **options)
    got = compare(Staging(odd), instances=ids, ordered=True, **options)
    for title in want.results:
        names = [c.replace(SRC, ids[0]).replace(TGT, ids[1]) for c in want[title].columns]
        assert got[title].columns == names
    found = {(r["section"], r["findings"]) for r in got.summary().collect()}
    assert found == {(r["section"], r["findings"]) for r in want.summary().collect()}
