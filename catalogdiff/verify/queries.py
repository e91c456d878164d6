"""One query per operator, over snapshots derived from the test tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogdiff import operators as op
from catalogdiff.functions import host_to_instance_id
from catalogdiff.plans import MAPPED_SECTIONS, SECTIONS, compare, custom_section, write_findings
from catalogdiff.plans.report import Report
from catalogdiff.sources import Staging, import_extracts, read_staged, stage, write_extract
from catalogdiff.verify.fixtures import SRC, STAR, TGT, THIRD, views

Query = Callable[[SparkSession, str], DataFrame]

OWNERS = ["SCH_3", "SCH_4"]
OWNER_MAP = [("SRC_3", "TGT_3")]
OWNER_MAPS = [("SRC_3", "TGT_3"), ("SRC_4", "TGT_4"), ("SRC_5", "TGT_6")]
PAIRS = [(SRC, TGT), (TGT, SRC), (SRC, THIRD), (TGT, THIRD)]

STAR_PAIRS = [(SRC, s) for s in STAR]

STAGED_VIEWS = {
    "instances": "fx_instances",
    "dbobjectnames": "fx_dbobjectnames",
    "columns": "fx_columns",
    "sourcecodedetailed": "fx_sourcecodedetailed",
    "indexes": "fx_indexes",
    "roleprivs": "fx_roleprivs",
    "sysprivs": "fx_sysprivs",
}
MAPPED_VIEWS = {
    "instances": "fx_instances",
    "dbobjectnames": "fx_mapped_objects",
    "columns": "fx_mapped_columns",
    "sourcecodedetailed": "fx_mapped_source",
}
PG_VIEWS = {
    "pg_namespace": "raw_pg_namespace",
    "pg_class": "raw_pg_class",
    "pg_inherits": "raw_pg_inherits",
    "pg_language": "raw_pg_language",
    "pg_proc": "raw_pg_proc",
    "pg_trigger": "raw_pg_trigger",
    "columns": "raw_pg_info_columns",
    "views": "raw_pg_info_views",
}
ORA_VIEWS = {
    "objects": "raw_ora_objects",
    "tab_partitions": "raw_ora_tab_partitions",
    "source": "raw_ora_source",
    "tab_columns": "raw_ora_tab_columns",
    "views": "raw_ora_views",
    "triggers": "raw_ora_triggers",
}
PG_TWO, ORA_TWO = {"pg_class": "raw_pg_class_two"}, {"objects": "raw_ora_objects_two"}
FLEET_PG_VIEWS = {t: f"fleet_{t}" for t in ("pg_namespace", "pg_class", "pg_inherits", "pg_language", "pg_proc", "pg_trigger")}
FLEET_ORA_VIEWS = {t: f"fleet_ora_{t}" for t in ("objects", "tab_partitions")}


def frames(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> dict[str, DataFrame]:
    return dict(zip(names, views(spark, sf_dir, *names.values()), strict=True))


def report(spark: SparkSession, sf_dir: str, mapped: bool = False, **options) -> Report:
    staging = Staging(frames(spark, sf_dir, MAPPED_VIEWS if mapped else STAGED_VIEWS))
    if "pairs" not in options:
        options.setdefault("instances", (SRC, TGT))
    return compare(staging, **options)


def objects_missing_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances are the first two staged ones, not named."""
    staging = frames(spark, sf_dir, {**STAGED_VIEWS, "instances": "fx_staged_instances"})
    return compare(Staging(staging), sections=["Missing Objects"])["Missing Objects"]


def objects_missing_after_empty_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One database is loaded again and has no objects any more; the others stay as they were loaded."""
    folder, first = shared_folder(spark), frames(spark, sf_dir, {t: STAGED_VIEWS[t] for t in ("instances", "dbobjectnames")})
    stage(first, folder)
    stage({"instances": first["instances"].where(F.col("pkey") == TGT), "dbobjectnames": first["dbobjectnames"].where("false")}, folder)
    staging = Staging.open(spark, folder)
    return compare(staging, instances=(SRC, TGT), sections=["Missing Objects"])["Missing Objects"]


def objects_missing_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One database against each of many: its rows are counted once, not once for each pair."""
    staging = frames(spark, sf_dir, {"instances": "fx_star_instances", "dbobjectnames": "fx_star_objects"})
    return compare(Staging(staging), pairs=STAR_PAIRS, sections=["Missing Objects"])["Missing Objects"]


def routines_missing_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routines of instances that have grants only: the third instance is not listed."""
    staging = frames(spark, sf_dir, {"instances": "fx_roleprivs", "sourcecodedetailed": "fx_three_sources"})
    return compare(Staging(staging), instances=(SRC, TGT), sections=["Missing PLSQL"])["Missing PLSQL"]


def line_count_staged_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts staged as such go before the lines of routines, which are not staged here."""
    title = "Mismatched Line Counts (PL/SQL)"
    staging = frames(spark, sf_dir, {"instances": "fx_instances", "sourcecode": "fx_sourcecode_staged"})
    return compare(Staging(staging), instances=(SRC, TGT), sections=[title])[title]


def section(title: str, mapped: bool = False, **options) -> Query:
    if mapped:
        options.setdefault("owner_maps", OWNER_MAP)
    return lambda spark, sf_dir: report(spark, sf_dir, mapped, sections=[title], **options)[title]


def pg(build: Callable[..., DataFrame], tables: dict[str, str] = PG_VIEWS, pkey: str | None = TGT, **options) -> Query:
    return lambda spark, sf_dir: build(frames(spark, sf_dir, tables), pkey, **options)


def ora(build: Callable[..., DataFrame], tables: dict[str, str] = ORA_VIEWS, pkey: str | None = SRC, **options) -> Query:
    return lambda spark, sf_dir: build(frames(spark, sf_dir, tables), pkey, **options)


def view(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(views(spark, sf_dir, name)[0])


def ora_user_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary as one connected user sees it: no owner columns."""
    raw = frames(spark, sf_dir, {k: ORA_VIEWS[k] for k in ("objects", "tab_partitions")})
    mine = {name: rows.drop("owner", "table_owner") for name, rows in raw.items()}
    return op.ora_objects(mine, SRC, scope="user", user="app_owner")


def staged_pair(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> Staging:
    return Staging({t: first[t].unionByName(second[t]) for t in first})


def compare_modes(mode: str) -> Query:
    """Normalise two databases, each in its own dialect, and list the objects one of them lacks."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sides = []
        for dialect, pkey in zip(mode.split("_to_"), ("db_one", "db_two"), strict=True):
            names = PG_VIEWS if dialect == "postgres" else ORA_VIEWS
            # In the second database views and sequences have other names.
            if pkey == "db_two":
                names = names | (PG_TWO if dialect == "postgres" else ORA_TWO)
            raw = frames(spark, sf_dir, names)
            build = op.normalize_postgres if dialect == "postgres" else op.normalize_oracle
            sides.append(build(raw, pkey))
        found = compare(staged_pair(*sides), instances=("db_one", "db_two"), sections=["Missing Objects"])
        return found["Missing Objects"]

    return query


def readable(findings: DataFrame) -> DataFrame:
    """Findings with the key map as text, for a comparison by value."""
    part = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL")))
    return findings.withColumn("key", F.array_join(F.transform(F.map_entries("key"), part), ", "))


def all_sections(spark: SparkSession, sf_dir: str) -> Report:
    return report(spark, sf_dir, sections=list(SECTIONS))


def mapped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(spark, sf_dir, mapped=True, sections=list(MAPPED_SECTIONS), owner_maps=OWNER_MAP)
    return readable(found.findings())


def shared_folder(spark: SparkSession) -> str:
    """A new folder all executors see; a local one only where the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors see")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared}/catalogdiff-{uuid.uuid4().hex}"


def extract_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write extracts, load them into staging, read staging back."""
    folder = shared_folder(spark)
    (columns,) = views(spark, sf_dir, "fx_columns")
    write_extract(columns, f"{folder}/extracts", "columns")
    import_extracts(spark, f"{folder}/extracts", f"{folder}/staging")
    return read_staged(spark, f"{folder}/staging", "columns").drop("dma_source_id", "dma_manual_id")


OWN_TABLE_TEXT = """
SELECT grantee, privilege, count(*) AS times FROM IDENTIFIER(:grants_seen) WHERE pkey = :instance_1_id GROUP BY grantee, privilege
"""


def extract_import_other_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract of a table of the user's own, loaded next to known ones and read by a custom section."""
    folder = shared_folder(spark)
    raw = frames(spark, sf_dir, {"instances": "fx_instances", "grants_seen": "fx_sysprivs"})
    for table, rows in raw.items():
        write_extract(rows, f"{folder}/extracts", table)
    import_extracts(spark, f"{folder}/extracts", f"{folder}/staging")
    staging = Staging.open(spark, f"{folder}/staging")
    return compare(staging, instances=(SRC, TGT), sections=[], custom={"Own": OWN_TABLE_TEXT})["Own"]


def drift_of_several_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns staged several times a side, with equal and with other declarations."""
    title = "Column Type Mismatches"
    staging = frames(spark, sf_dir, {"instances": "fx_instances", "columns": "fx_columns_repeated"})
    return compare(Staging(staging), instances=(SRC, TGT), sections=[title])[title]


def drift_of_several_declarations_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = "Column Type Mismatches"
    staging = frames(spark, sf_dir, {"instances": "fx_instances", "columns": "fx_columns_repeated"})
    return compare(Staging(staging), pairs=[(SRC, TGT), (TGT, SRC)], sections=[title])[title]


def findings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the default sections, written by section and read back."""
    folder = shared_folder(spark)
    write_findings(report(spark, sf_dir), folder)
    columns = ("pair_id", "section", "key", "value_1", "value_2")
    return readable(spark.read.parquet(f"{folder}/findings").select(*columns))


CUSTOM_TEXT = """
SELECT t.owner, t.data_type,
       count_if(t.pkey = :instance_1_id) AS columns_1, count_if(t.pkey = :instance_2_id) AS columns_2
FROM IDENTIFIER(:columns) t
WHERE :all_owners OR array_contains(:owners, t.owner)
GROUP BY t.owner, t.data_type
"""

CUSTOM_TEMPLATE = """
SELECT a.OWNER AS owner, a.OBJECT_TYPE AS object_type, '<instance_1_id>' AS of_instance,
       COUNT(DISTINCT a.OBJECT_NAME) AS <instance_1_id>_names
FROM <dataset_name>.dbobjectnames a WHERE a.PKEY = '<instance_1_id>' <a_schema_filter>
GROUP BY a.OWNER, a.OBJECT_TYPE;
"""

CUSTOM_TEMPLATE_IN_TEXT = """
-- What '<instance_1_id> doesn't share.
SELECT 'Only in <instance_1_id>, not <instance_2_id>' AS note, a.OWNER AS owner, COUNT(*) AS names
FROM <dataset_name>.dbobjectnames a WHERE a.PKEY = '<instance_1_id>' <a_schema_filter>
GROUP BY a.OWNER;
"""


CUSTOM_TEXT_OF_PAIRS = """
SELECT t.pair_id, t.owner, t.data_type, count_if(t.side = 1) AS columns_1, count_if(t.side = 2) AS columns_2
FROM IDENTIFIER(:columns) t
WHERE :all_owners OR array_contains(:owners, t.owner)
GROUP BY t.pair_id, t.owner, t.data_type
"""


def custom_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a custom section over many pairs, which groups by pair itself, next to a built-in one."""
    found = report(spark, sf_dir, sections=["Missing Sys Privileges"], pairs=PAIRS, custom={"Types": CUSTOM_TEXT_OF_PAIRS})
    return readable(found.findings())


def custom(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = report(spark, sf_dir, sections=[], owners=OWNERS)
        return custom_section(text, found.comparison)

    return query


def findings_with_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a built-in section and of a custom one."""
    return readable(report(spark, sf_dir, sections=["Missing PLSQL"], custom={"Types": CUSTOM_TEXT}).findings())


def host_instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance ids of hosts: those of the pages, and their numbers written as addresses."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    quad = F.concat_ws(".", F.lit("10"), *(F.expr(f"cast(page_id div {d} % 256 as string)") for d in (65536, 256, 1)))
    hosts = pages.select(F.explode(F.array(F.regexp_extract("url", "//([^/:]+)", 1), quad)).alias("host"))
    ids = {d: host_to_instance_id(F.col("host"), d) for d in ("oracle", "postgres")}
    return hosts.select("host", *(c.alias(f"{d}_id") for d, c in ids.items()))


QUERIES: dict[str, Query] = {
    # Comparison of two instances.
    "instances": view("fx_staged_instances", op.instances),
    "object_counts": section("All Object Counts"),
    "object_counts_mismatch": section("Mismatched Object Counts"),
    "object_counts_per_schema": section("All Object Counts (per Schema)"),
    "object_counts_per_schema_mismatch": section("Mismatched Object Counts (per Schema)"),
    "objects_missing": section("Missing Objects"),
    "objects_missing_owner_filter": section("Missing Objects", owners=OWNERS),
    "objects_missing_deduped": section("Missing Objects", dedupe=True),
    "objects_missing_own_universe": section("Missing Objects", universe="pair"),
    "objects_missing_picked_instances": objects_missing_picked,
    "objects_missing_long_owner_list": section("Missing Objects", owners=[*OWNERS, *(f"NOBODY_{i}" for i in range(1500))]),
    "objects_missing_after_empty_reload": objects_missing_after_empty_reload,
    "columns_missing": section("Missing Columns"),
    "columns_missing_owner_filter": section("Missing Columns", owners=OWNERS),
    "indexes_missing": section("Missing Indexes"),
    "indexes_missing_deduped": section("Missing Indexes", dedupe=True),
    "routines_missing": section("Missing PLSQL"),
    "routines_missing_listed_instances": routines_missing_listed,
    "column_type_mismatch": section("Column Type Mismatches"),
    "column_type_mismatch_several_declarations": drift_of_several_declarations,
    "line_count_mismatch": section("Mismatched Line Counts (PL/SQL)"),
    "line_count_mismatch_staged_rollup": line_count_staged_rollup,
    "line_count_mismatch_detailed": section("Mismatched Line Counts per Object (PL/SQL)"),
    "role_grants_missing": section("Missing Role Grants"),
    "sys_privs_missing": section("Missing Sys Privileges"),
    # Comparison of schemas with different names.
    "mapped_instances": view("fx_staged_instances", op.instances),
    "mapped_object_counts": section("All Object Counts", mapped=True),
    "mapped_objects_missing": section("Missing Objects", mapped=True),
    "mapped_columns_missing": section("Missing Columns", mapped=True),
    "mapped_routines_missing": section("Missing PLSQL", mapped=True),
    "mapped_objects_missing_many_maps": section("Missing Objects", mapped=True, owner_maps=OWNER_MAPS),
    "mapped_columns_missing_many_maps": section("Missing Columns", mapped=True, owner_maps=OWNER_MAPS),
    "mapped_null_names_missing": view(
        "fx_mapped_names",
        lambda rows: op.mapped_presence_diff(rows, ("object_name", "object_type"), op.TwoInstances(SRC, TGT), OWNER_MAP),
    ),
    # Many pairs in one job.
    "objects_missing_many_pairs": section("Missing Objects", pairs=PAIRS),
    "objects_missing_star_of_pairs": objects_missing_star,
    "columns_missing_many_pairs": section("Missing Columns", pairs=PAIRS),
    "indexes_missing_many_pairs": section("Missing Indexes", pairs=PAIRS),
    "routines_missing_many_pairs": section("Missing PLSQL", pairs=PAIRS),
    "line_count_mismatch_many_pairs": section("Mismatched Line Counts (PL/SQL)", pairs=PAIRS),
    "line_count_mismatch_detailed_many_pairs": section("Mismatched Line Counts per Object (PL/SQL)", pairs=PAIRS),
    "role_grants_missing_many_pairs": section("Missing Role Grants", pairs=PAIRS),
    "object_counts_mismatch_many_pairs": section("Mismatched Object Counts", pairs=PAIRS),
    "column_type_mismatch_several_declarations_many_pairs": drift_of_several_declarations_of_pairs,
    "mapped_objects_missing_many_pairs": section("Missing Objects", mapped=True, pairs=[(SRC, TGT), (SRC, THIRD)], owner_maps=OWNER_MAPS),
    "column_type_mismatch_many_pairs": section("Column Type Mismatches", pairs=PAIRS),
    "object_counts_many_pairs": section("All Object Counts", pairs=PAIRS),
    "object_counts_many_pairs_repeated": section("All Object Counts", pairs=[*PAIRS, *PAIRS]),
    # Normalisers.
    "pg_columns": pg(op.pg_columns),
    "pg_columns_by_name_only": pg(op.pg_columns, compat=True),
    "pg_instance": pg(op.pg_instance, FLEET_PG_VIEWS, None),
    "pg_views": pg(op.pg_views),
    "pg_objects": pg(op.pg_objects),
    "pg_objects_many_databases": pg(op.pg_objects, FLEET_PG_VIEWS, None),
    "pg_source_lines": pg(op.pg_source_lines),
    "pg_triggers": pg(op.pg_triggers),
    "ora_columns": ora(op.ora_columns),
    "ora_columns_owner_filter": ora(op.ora_columns, owners=["sch_3", "sch_4"]),
    "ora_instance": ora(op.ora_instance, FLEET_ORA_VIEWS, None),
    "ora_views": ora(op.ora_views),
    "ora_objects": ora(op.ora_objects),
    "ora_objects_many_databases": ora(op.ora_objects, FLEET_ORA_VIEWS, None),
    "ora_objects_user_scope": ora_user_objects,
    "ora_source_lines": ora(op.ora_source_lines),
    "ora_triggers": ora(op.ora_triggers),
    "sourcecode_rollup": view("fx_sourcecodedetailed", op.sourcecode_rollup),
    "supplied_indexes": view("fx_indexes", lambda rows: op.supplied(rows, "indexes", source="Oracle")),
    "supplied_roleprivs": view("fx_roleprivs", lambda rows: op.supplied(rows, "roleprivs", source="Oracle")),
    "supplied_sysprivs": view("fx_sysprivs", lambda rows: op.supplied(rows, "sysprivs", source="Oracle")),
    # End to end from raw catalogs, by mode.
    "compare_oracle_to_postgres": compare_modes("oracle_to_postgres"),
    "compare_oracle_to_oracle": compare_modes("oracle_to_oracle"),
    "compare_postgres_to_postgres": compare_modes("postgres_to_postgres"),
    # Selection, sources, report.
    "instance_rank": view("fx_fleet_instances", op.instance_rank),
    "host_instance_ids": host_instance_ids,
    "extract_roundtrip": extract_roundtrip,
    "extract_import_other_table": extract_import_other_table,
    "custom_section": custom(CUSTOM_TEXT),
    "custom_template": custom(CUSTOM_TEMPLATE),
    "custom_template_in_text": custom(CUSTOM_TEMPLATE_IN_TEXT),
    "findings": lambda spark, sf_dir: readable(all_sections(spark, sf_dir).findings()),
    "findings_with_custom": findings_with_custom,
    "custom_section_many_pairs": custom_of_pairs,
    "findings_written": findings_written,
    "section_summary": lambda spark, sf_dir: all_sections(spark, sf_dir).summary(),
    "section_summary_many_pairs": lambda spark, sf_dir: report(
        spark, sf_dir, sections=["Missing Objects"], pairs=[*PAIRS, *PAIRS]
    ).summary(),
    "mapped_findings": mapped_findings,
}
