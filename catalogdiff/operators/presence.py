"""Presence diff: keys that one side of a comparison does not have.

One aggregate counts both sides per key, so both sides and the universe of keys
go through one exchange, combined before it. Joining the universe to each side
would take three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogdiff.functions import all_present
from catalogdiff.operators import pairs
from catalogdiff.operators.copies import repeat_rows
from catalogdiff.operators.selection import InstancePairs, TwoInstances, edge_roles, map_columns, map_owners, map_roles

Sides = TwoInstances | InstancePairs

_LACKS_A_SIDE = "_n1 = 0 OR _n2 = 0"


def _side_counts(keys: Sequence[str]) -> tuple[Column, Column]:
    """Rows of each side; a key with a NULL part matches nothing, so it counts for no side."""
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return F.expr(f"count_if(side = 1 AND {whole}) AS _n1"), F.expr(f"count_if(side = 2 AND {whole}) AS _n2")


def _status() -> list[Column]:
    return [F.expr(f"CASE WHEN _n{side} > 0 THEN 'Present' ELSE 'Missing' END AS status_{side}") for side in (1, 2)]


def _finish(
    counted: DataFrame, shown: Sequence[str], sides: Sides, dedupe: bool, order: Sequence[str]
) -> DataFrame:
    """Statuses, and each row as often as the side that has it holds it."""
    columns = [*sides.group, *shown, *_status()]
    if dedupe:
        found = counted.select(*columns)
        found = found.orderBy(*order) if order else found
    else:
        found = counted.select(*columns, F.expr("greatest(_n1, _n2, 1L) AS _copies"))
        found = repeat_rows(found, "_copies", order=order)
    return sides.labelled(found, "status")


def lacking(rows: DataFrame, keys: Sequence[str], sides: Sides) -> DataFrame:
    """One row per key that a side lacks, with the row counts ``_n1, _n2``."""
    if isinstance(sides, InstancePairs):
        return pairs.lacking(pairs.counted_by(sides.nodes(rows), keys), keys, sides.edges, sides.small, sides.count)
    return sides.tag(rows).groupBy(*keys).agg(*_side_counts(keys)).where(_LACKS_A_SIDE)


def finest(rows: DataFrame, keys: Sequence[str], sides: Sides) -> DataFrame:
    """The aggregate that counts and presence diffs of one table can share: rows per key and side, or per key and instance."""
    if isinstance(sides, InstancePairs):
        return pairs.counted_by(sides.nodes(rows), keys)
    each = [F.expr(f"count_if(side = {side})").alias(f"_r{side}") for side in (1, 2)]
    return sides.tag(rows).groupBy(*keys).agg(*each)


def lacking_of(counted: DataFrame, keys: Sequence[str], sides: Sides, only: str | None = None) -> DataFrame:
    """As ``lacking``, from the ``finest`` aggregate. ``only`` filters keys behind it, so that others share it unfiltered."""
    if only is not None:
        # Keys of a count as well: filters of keys alone, those a join adds too, would be moved before the aggregate.
        count = "_n" if isinstance(sides, InstancePairs) else "_r1 + _r2 + 1L"
        counted = counted.where(f"IF({only}, {count}, 0L) > 0").withColumns({k: F.expr(f"IF({count} > 0, {k}, NULL)") for k in keys})
    if isinstance(sides, InstancePairs):
        return pairs.lacking(counted, keys, sides.edges, sides.small, sides.count)
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return counted.selectExpr(*keys, *(f"IF({whole}, _r{side}, 0L) AS _n{side}" for side in (1, 2))).where(_LACKS_A_SIDE)


def presence_diff(
    rows: DataFrame,
    keys: Sequence[str],
    sides: Sides,
    dedupe: bool = False,
    unless: DataFrame | None = None,
    unless_on: Sequence[tuple[str, str]] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Keys missing on a side, with a status per side.

    ``unless`` drops findings that have a match there on the column pairs
    ``unless_on`` (and the same pair); a NULL matches nothing.
    """
    found = _without(lacking(rows, keys, sides), unless, unless_on, sides.group)
    return presence_of(found, keys, sides, dedupe, order)


def presence_of(
    found: DataFrame, keys: Sequence[str], sides: Sides, dedupe: bool = False, order: Sequence[str] = ()
) -> DataFrame:
    """The presence diff of keys that were ``found`` to be lacking."""
    return _finish(found, keys, sides, dedupe, order)


def presence_diff_by_variant(
    rows: DataFrame,
    keys: Sequence[str],
    variant: str,
    keep: Column,
    sides: Sides,
    dedupe: bool = False,
    order: Sequence[str] = (),
) -> DataFrame:
    """Presence diff on ``keys`` that lists a finding once per distinct ``variant`` kept.

    The variant is not part of the key: counts are summed over all variants of a key.
    Variants are a small vocabulary, so the set of them is bounded and one aggregate does.
    With ``dedupe`` a finding with a variant kept is listed once.
    """
    kind = F.when(keep, F.col(variant))
    if isinstance(sides, InstancePairs):
        per_instance = pairs.counted_by(sides.nodes(rows), keys, extra=kind)
        found = pairs.lacking(per_instance, keys, sides.edges, sides.small, sides.count).withColumnRenamed("_extra", "_kinds")
    else:
        counted = sides.tag(rows).groupBy(*sides.group, *keys).agg(*_side_counts(keys), F.collect_set(kind).alias("_kinds"))
        found = counted.where(_LACKS_A_SIDE)
    found = found.where("size(_kinds) > 0")
    if not dedupe:
        found = found.withColumn("_kind", F.explode("_kinds"))
    return _finish(found, keys, sides, dedupe, order)


def mapped_lacking(
    rows: DataFrame, keys: Sequence[str], sides: Sides, owner_maps: Sequence[tuple[str, str]]
) -> DataFrame:
    """As ``lacking`` between mapped owners: the owner is not in the key, and is shown.

    Rows with a NULL key part belong to the side that holds them, so those
    are kept apart by owner.
    """
    many = isinstance(sides, InstancePairs)
    mine = map_roles(sides.nodes(rows), owner_maps) if many else map_owners(sides.tag(rows, own_only=True), owner_maps)
    mine = mine.withColumn("_loose", F.when(~all_present(keys), F.col("owner")))
    group = ("owner_1", "owner_2", "_loose", *keys)
    if many:
        found = pairs.lacking(pairs.counted_by(mine, group), group, edge_roles(sides.edges), sides.small, None, whole=keys)
    else:
        found = mine.groupBy(*group).agg(*_side_counts(keys)).where(_LACKS_A_SIDE)
    holder = F.when(F.col("_n1") > 0, F.col("owner_1")).otherwise(F.col("owner_2"))
    return found.withColumn("owner", F.coalesce("_loose", holder))


def mapped_presence_diff(
    rows: DataFrame,
    keys: Sequence[str],
    sides: Sides,
    owner_maps: Sequence[tuple[str, str]],
    dedupe: bool = False,
    unless: DataFrame | None = None,
    unless_on: Sequence[tuple[str, str]] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Presence diff between owner 1 of side 1 and owner 2 of side 2."""
    found = mapped_lacking(rows, keys, sides, owner_maps)
    maps = map_columns(owner_maps)
    found = _without(found, unless, unless_on, [*sides.group, *maps])
    return _finish(found, [*maps, "owner", *keys], sides, dedupe, order)


def _without(
    found: DataFrame, unless: DataFrame | None, on: Sequence[tuple[str, str]], group: Sequence[str]
) -> DataFrame:
    # An anti join, not NOT IN: it stays an equi join. Neither side is hinted,
    # both grow with the data.
    if unless is None:
        return found
    names = [*group, *(mine for mine, _ in on)]
    other = unless.select(*group, *(F.col(theirs).alias(mine) for mine, theirs in on))
    return found.join(other, names, "left_anti")
