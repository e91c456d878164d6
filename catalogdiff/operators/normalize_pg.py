"""Raw Postgres catalog tables → staged tables.

``raw`` maps a catalog table's name (see ``sources.jdbc.POSTGRES``) to a
DataFrame. With ``pkey`` given they describe one database; without, each has a
``pkey`` column and holds many databases, and every join is within one.

No table is broadcast by hint: sizes differ by database, and Spark checks them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from catalogdiff.functions import line_count, listed, literal, regclass_text
from catalogdiff.operators.copies import repeat_rows
from catalogdiff.operators.selection import described, filter_owners
from catalogdiff.schemas import conform

Raw = Mapping[str, DataFrame]

# Schemas left out, by kind of fact.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
RELATION_SYSTEM_SCHEMAS = (*SYSTEM_SCHEMAS, "pg_toast")
TRIGGER_SYSTEM_SCHEMAS = ("public", "information_schema")

# Relation kinds collected, and the object type of a kind.
# Case matters: S is a sequence, I and i are indexes.
RELATION_KINDS = ("r", "v", "m", "i", "S", "t", "p", "I")
KIND_TYPES = {
    "r": "TABLE",
    "v": "VIEW",
    "m": "MATERIALIZED VIEW",
    "S": "SEQUENCE",
    "t": "TOAST TABLE",
    "p": "PARTITIONED TABLE",
}
ROUTINE_TYPES = {"p": "PROCEDURE", "f": "FUNCTION"}
ROUTINE_LANGUAGE = "plpgsql"


class _Catalog:
    """The raw tables, keyed by database where they hold more than one."""

    def __init__(self, raw: Raw, pkey: str | None):
        self.raw = raw
        self.pkey = pkey
        self.db = [] if pkey is not None else ["pkey"]

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.raw[name].selectExpr(*self.db, *columns)

    def namespaces(self, hidden: Sequence[str]) -> DataFrame:
        return self.table("pg_namespace", "oid AS nsp", "nspname").where(f"nspname NOT IN ({listed(hidden)})")

    def stage(self, df: DataFrame, table: str, owners: Sequence[str] | None, **columns: str) -> DataFrame:
        if self.pkey is not None:
            columns["pkey"] = literal(self.pkey)
        staged = conform(df, table, dma_source_id="'Postgres'", con_id="1", **columns)
        return filter_owners(staged, owners)


def _typed(kind: str, types: Mapping[str, str], otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in types.items())
    return f"CASE {kind} {cases} ELSE {otherwise} END"


def pg_instance(raw: Raw, pkey: str | None = None) -> DataFrame:
    """One row per database described."""
    schemas = raw["pg_namespace"]
    if pkey is None:
        return conform(described(raw), "instances")
    return conform(schemas.sparkSession.range(1), "instances", pkey=literal(pkey))


def pg_columns(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, compat: bool = False
) -> DataFrame:
    """Columns of relations that are no partitions; pseudo column ROWID left out.

    A column repeats once per relation it matches. ``compat`` matches relations
    by name only, so a name used in n schemas repeats each column n times.
    """
    cat = _Catalog(raw, pkey)
    relations = cat.table("pg_class", "oid", "relname AS table_name", "relnamespace AS nsp")
    partitions = cat.table("pg_inherits", "inhrelid AS oid")
    schemas = cat.table("pg_namespace", "oid AS nsp", "nspname AS table_schema")
    match = [*cat.db, "table_name"] if compat else [*cat.db, "table_schema", "table_name"]
    # Counted per name first: one common table name cannot blow up the join.
    relations = (
        relations.join(partitions, [*cat.db, "oid"], "left_anti")
        .join(schemas, [*cat.db, "nsp"])
        .groupBy(*match)
        .count()
    )
    columns = raw["columns"].where(
        f"table_schema NOT IN ({listed(SYSTEM_SCHEMAS)}) AND upper(column_name) <> 'ROWID'"
    )
    found = repeat_rows(columns.join(relations, match), "count", spread=False)
    return cat.stage(
        found,
        "columns",
        owners,
        owner="upper(table_schema)",
        table_name="upper(table_name)",
        column_name="upper(column_name)",
        data_type="upper(data_type)",
        data_length="character_maximum_length",
        data_precision="numeric_precision",
        data_scale="numeric_scale",
        nullable="is_nullable",
    )


def pg_views(raw: Raw, pkey: str | None = None) -> DataFrame:
    """Views outside the system schemas; never filtered by owner."""
    cat = _Catalog(raw, pkey)
    found = raw["views"].where(f"table_schema NOT IN ({listed(SYSTEM_SCHEMAS)})")
    return cat.stage(found, "views", None, owner="upper(table_schema)", view_name="upper(table_name)")


def _relations(cat: _Catalog) -> DataFrame:
    # Parents are counted per child: the join then meets one row per child, and
    # a child of several parents still repeats.
    parents = cat.table("pg_inherits", "inhrelid AS oid").groupBy(*cat.db, "oid").count()
    relations = (
        cat.table("pg_class", "oid", "relname AS name", "relnamespace AS nsp", "relkind")
        .where(f"relkind IN ({listed(RELATION_KINDS)})")
        .join(cat.namespaces(RELATION_SYSTEM_SCHEMAS), [*cat.db, "nsp"])
        .join(parents, [*cat.db, "oid"], "left")
    )
    relations = relations.selectExpr(
        *cat.db,
        "nspname",
        "name",
        "CASE WHEN relkind = 'r' AND count IS NOT NULL THEN 'TABLE PARTITION'"
        " WHEN relkind IN ('i', 'I') AND count IS NULL THEN 'INDEX'"
        f" ELSE {_typed('relkind', KIND_TYPES, 'relkind')} END AS object_type",
        "coalesce(count, 1L) AS _copies",
    )
    return repeat_rows(relations, "_copies", spread=False)


def _routines(cat: _Catalog, *extra: str) -> DataFrame:
    """Routines of the one collected language. ``extra`` is computed in the scan, before any join."""
    language = cat.table("pg_language", "oid AS prolang", "lanname")
    language = language.where(f"lanname = {literal(ROUTINE_LANGUAGE)}").drop("lanname")
    kind = f"{_typed('prokind', ROUTINE_TYPES)} AS object_type"
    routines = cat.table("pg_proc", "pronamespace AS nsp", "proname AS name", kind, "prolang", *extra)
    return routines.join(language, [*cat.db, "prolang"], "left_semi").join(
        cat.namespaces(SYSTEM_SCHEMAS), [*cat.db, "nsp"]
    )


def _triggers(cat: _Catalog) -> DataFrame:
    relations = cat.table("pg_class", "oid", "relname", "relnamespace AS nsp")
    return (
        cat.table("pg_trigger", "tgrelid AS oid", "tgname AS name", "tgisinternal", "tgenabled")
        .where("NOT tgisinternal")
        .join(relations, [*cat.db, "oid"])
        .join(cat.namespaces(TRIGGER_SYSTEM_SCHEMAS), [*cat.db, "nsp"])
    )


def pg_objects(raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None) -> DataFrame:
    """Relations, routines and triggers. Overloads and children of several parents repeat.

    Index partitions stay out, and so do routines that are neither procedure
    nor function (their type is NULL, which is not unequal to ``i``).
    """
    cat = _Catalog(raw, pkey)
    columns = [*cat.db, "nspname", "name"]
    found = (
        _relations(cat)
        .unionByName(_routines(cat).select(*columns, "object_type"))
        .unionByName(_triggers(cat).selectExpr(*columns, "'TRIGGER' AS object_type"))
        .where("object_type <> 'i' AND upper(name) NOT LIKE '%_ROWID%'")
    )
    return cat.stage(found, "dbobjectnames", owners, owner="upper(nspname)", object_name="upper(name)")


def pg_source_lines(raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None) -> DataFrame:
    """Lines of each routine's definition. The text is counted where it is read and never shuffled."""
    cat = _Catalog(raw, pkey)
    found = _routines(cat, f"{line_count('definition')} AS nr_lines")
    return cat.stage(
        found, "sourcecodedetailed", owners, owner="upper(nspname)", name="upper(name)", type="object_type"
    )


def pg_triggers(
    raw: Raw,
    pkey: str | None = None,
    owners: Sequence[str] | None = None,
    search_path: Sequence[str] = ("public",),
) -> DataFrame:
    """Triggers with names as stored; the table is printed as Postgres prints a ``regclass``."""
    cat = _Catalog(raw, pkey)
    return cat.stage(
        _triggers(cat),
        "triggers",
        owners,
        owner="nspname",
        trigger_name="name",
        table_name=regclass_text("nspname", "relname", search_path),
        status="tgenabled",
    )


def normalize_postgres(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, compat: bool = False
) -> dict[str, DataFrame]:
    """All tables the Postgres collector fills."""
    return {
        "instances": pg_instance(raw, pkey),
        "columns": pg_columns(raw, pkey, owners, compat),
        "views": pg_views(raw, pkey),
        "dbobjectnames": pg_objects(raw, pkey, owners),
        "sourcecodedetailed": pg_source_lines(raw, pkey, owners),
        "triggers": pg_triggers(raw, pkey, owners),
    }
