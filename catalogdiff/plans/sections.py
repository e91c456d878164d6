"""The report's sections: an ordered registry of titles and DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogdiff.functions import listed
from catalogdiff.operators import drift
from catalogdiff.operators.counts import count_diff, counts_of, line_diff, mapped_count_diff
from catalogdiff.operators.presence import (
    Sides,
    finest,
    lacking,
    lacking_of,
    mapped_lacking,
    mapped_presence_diff,
    presence_diff,
    presence_diff_by_variant,
    presence_of,
)
from catalogdiff.operators.selection import InstancePairs, filter_owners, instances, known_instances

# The types whose absence explains that all their columns are absent.
TABLE_TYPES = ("TABLE", "PARTITIONED TABLE")

OBJECT = ("owner", "object_name", "object_type")
COLUMN = ("owner", "table_name", "column_name")
ROUTINE = ("owner", "name", "type")
INDEX = ("owner", "table_name", "index_name")
ROLE_GRANT = ("grantee", "granted_role")
SYSTEM_GRANT = ("grantee", "privilege")


@dataclass(frozen=True)
class Comparison:
    """What a section works on: staged tables, sides, and the filters of the run."""

    staging: Mapping[str, DataFrame]
    sides: Sides
    owners: Sequence[str] | None = None
    owner_maps: Sequence[tuple[str, str]] | None = None
    dedupe: bool = False
    order: Sequence[str] = ()
    # Whether sections of one report count objects, which one aggregate then does for all of them.
    shared: bool = False

    @property
    def result(self) -> dict:
        """How results that repeat rows are finished."""
        return {"dedupe": self.dedupe, "order": self.order}

    def sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*self.order) if self.order else df

    def table(self, name: str, known: bool = False, own: bool = False) -> DataFrame:
        """A table; ``known`` keeps listed instances only, ``own`` reads those compared only, where they are named.

        Instances that are compared are listed ones, as the sides check.
        """
        sides = self.sides
        own = own or isinstance(sides, InstancePairs) or sides.universe == "pair"
        staging = self.staging.of(sides.ids) if own and sides.ids is not None and hasattr(self.staging, "of") else self.staging
        if known and not (own and sides.listed is not None):
            return known_instances(staging[name], self.staging["instances"])
        return staging[name]

    def rows(self, table: str, known: bool = False, own: bool = False) -> DataFrame:
        """Rows of a table for the owners compared.

        The owner is part of every key these rows are compared on, so filtering
        before the comparison gives what filtering after it would.
        """
        return filter_owners(self.table(table, known, own), self.owners)


    def objects(self) -> DataFrame:
        """Objects per key and side: counts are its rollup, missing objects and tables its filters."""
        return finest(self.rows("dbobjectnames"), OBJECT, self.sides)


def instance_list(c: Comparison) -> DataFrame:
    return c.sorted(instances(c.staging["instances"]))


def _object_counts(c: Comparison, mismatch: bool) -> DataFrame:
    keys = ("owner", "object_type")
    if c.shared:
        return c.sorted(counts_of(c.objects(), keys, c.sides, mismatch))
    return c.sorted(count_diff(c.rows("dbobjectnames", own=mismatch), keys, c.sides, mismatch))


def object_counts(c: Comparison) -> DataFrame:
    return _object_counts(c, mismatch=False)


def object_counts_mismatch(c: Comparison) -> DataFrame:
    return _object_counts(c, mismatch=True)


def missing_objects(c: Comparison) -> DataFrame:
    if c.shared:
        return presence_of(lacking_of(c.objects(), OBJECT, c.sides), OBJECT, c.sides, **c.result)
    return presence_diff(c.rows("dbobjectnames"), OBJECT, c.sides, **c.result)


def missing_columns(c: Comparison) -> DataFrame:
    """Missing columns, without those of a table that is missing itself.

    Being TABLE on one side and PARTITIONED TABLE on the other is missing too.
    """
    tables = f"object_type IN ({listed(TABLE_TYPES)})"
    if c.shared:
        gone = lacking_of(c.objects(), OBJECT, c.sides, tables)
    else:
        gone = lacking(c.rows("dbobjectnames").where(tables), OBJECT, c.sides)
    return presence_diff(
        c.rows("columns", known=True),
        COLUMN,
        c.sides,
        **c.result,
        unless=gone,
        unless_on=[("owner", "owner"), ("table_name", "object_name")],
    )


def missing_indexes(c: Comparison) -> DataFrame:
    """Missing indexes, once per staged type of the index; LOB and untyped ones left out."""
    shown = F.col("index_type") != "LOB"
    return presence_diff_by_variant(c.rows("indexes", known=True), INDEX, "index_type", shown, c.sides, **c.result)


def missing_routines(c: Comparison) -> DataFrame:
    return presence_diff(c.rows("sourcecodedetailed", known=True), ROUTINE, c.sides, **c.result)


def column_type_mismatch(c: Comparison) -> DataFrame:
    return drift.column_drift(c.rows("columns", own=True), c.sides, **c.result)


def line_count_mismatch(c: Comparison) -> DataFrame:
    return c.sorted(line_diff(c.rows("sourcecode", own=True), ("owner", "type"), "sum_nr_lines", c.sides))


def line_count_mismatch_detailed(c: Comparison) -> DataFrame:
    return c.sorted(line_diff(c.rows("sourcecodedetailed", own=True), ROUTINE, "nr_lines", c.sides))


def _grants(c: Comparison, table: str, keys: Sequence[str]) -> DataFrame:
    """Grants have no owner, so the owner filter does not apply."""
    return presence_diff(c.table(table, known=True), keys, c.sides, **c.result)


def missing_role_grants(c: Comparison) -> DataFrame:
    return _grants(c, "roleprivs", ROLE_GRANT)


def missing_sys_privs(c: Comparison) -> DataFrame:
    return _grants(c, "sysprivs", SYSTEM_GRANT)


def mapped_object_counts(c: Comparison) -> DataFrame:
    return c.sorted(mapped_count_diff(c.table("dbobjectnames", own=True), "object_type", c.sides, c.owner_maps))


def mapped_missing_objects(c: Comparison) -> DataFrame:
    return mapped_presence_diff(c.table("dbobjectnames", own=True), OBJECT[1:], c.sides, c.owner_maps, **c.result)


def mapped_missing_columns(c: Comparison) -> DataFrame:
    objects = c.table("dbobjectnames", own=True).where(F.col("object_type").isin(*TABLE_TYPES))
    return mapped_presence_diff(
        c.table("columns", known=True, own=True),
        COLUMN[1:],
        c.sides,
        c.owner_maps,
        **c.result,
        unless=mapped_lacking(objects, OBJECT[1:], c.sides, c.owner_maps),
        unless_on=[("owner", "owner"), ("table_name", "object_name")],
    )


def mapped_missing_routines(c: Comparison) -> DataFrame:
    rows = c.table("sourcecodedetailed", known=True, own=True)
    return mapped_presence_diff(rows, ROUTINE[1:], c.sides, c.owner_maps, **c.result)


@dataclass(frozen=True)
class Section:
    """``keys`` name a finding, ``values`` are per side, ``order`` is how a report sorts."""

    title: str
    build: Callable[[Comparison], DataFrame]
    keys: tuple[str, ...]
    values: tuple[str, ...]
    order: tuple[str, ...]
    default: bool = True

    def value(self, side: int) -> Column | None:
        return F.col(f"{self.values[0]}_{side}") if len(self.values) == 1 else None


# Sections that one aggregate of objects serves.
OF_OBJECTS = (object_counts, object_counts_mismatch, missing_objects, missing_columns)

_STATUS, _COUNT, _LINES = ("status",), ("count",), ("line_count",)
_BY_OWNER = ("owner", "object_type")

# Titles, their order, and which are on unless others are asked for.
SECTIONS: dict[str, Section] = {
    s.title: s
    for s in (
        Section("Instances", instance_list, ("instance_id",), (), ("instance_id",)),
        Section("Mismatched Object Counts", object_counts_mismatch, _BY_OWNER, _COUNT, _BY_OWNER),
        Section("All Object Counts", object_counts, _BY_OWNER, _COUNT, ("object_type",)),
        Section("All Object Counts (per Schema)", object_counts, _BY_OWNER, _COUNT, _BY_OWNER),
        Section("Mismatched Object Counts (per Schema)", object_counts_mismatch, _BY_OWNER, _COUNT, _BY_OWNER),
        Section("Missing Objects", missing_objects, OBJECT, _STATUS, ("object_type", "object_name")),
        Section("Missing Columns", missing_columns, COLUMN, _STATUS, COLUMN),
        Section("Missing Indexes", missing_indexes, INDEX, _STATUS, INDEX, default=False),
        Section("Column Type Mismatches", column_type_mismatch, COLUMN, drift.SHOWN, COLUMN, default=False),
        Section(
            "Mismatched Line Counts (PL/SQL)", line_count_mismatch, ("owner", "type"), _LINES, ("owner", "type"),
            default=False,
        ),
        Section("Missing PLSQL", missing_routines, ROUTINE, _STATUS, ("type", "name")),
        Section(
            "Mismatched Line Counts per Object (PL/SQL)", line_count_mismatch_detailed, ROUTINE, _LINES,
            ("owner", "type", "name"), default=False,
        ),
        Section("Missing Role Grants", missing_role_grants, ROLE_GRANT, _STATUS, ROLE_GRANT, default=False),
        Section("Missing Sys Privileges", missing_sys_privs, SYSTEM_GRANT, _STATUS, SYSTEM_GRANT, default=False),
    )
}

MAPPED_SECTIONS: dict[str, Section] = {
    s.title: s
    for s in (
        Section("Instances", instance_list, ("instance_id",), (), ("instance_id",)),
        Section("All Object Counts", mapped_object_counts, ("object_type",), _COUNT, ()),
        Section("Missing Objects", mapped_missing_objects, OBJECT, _STATUS, ("object_type", "object_name")),
        Section("Missing Columns", mapped_missing_columns, COLUMN, _STATUS, ("table_name", "column_name")),
        Section("Missing PLSQL", mapped_missing_routines, ROUTINE, _STATUS, ("type", "name")),
    )
}
