"""Columns both sides have whose declared attributes differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.functions import all_present, differs
from catalogdiff.operators import pairs
from catalogdiff.operators.copies import repeat_rows
from catalogdiff.operators.presence import Sides
from catalogdiff.operators.selection import InstancePairs

KEYS = ("owner", "table_name", "column_name")
COMPARED = ("data_type", "data_length", "data_precision", "data_scale", "nullable")
SHOWN = ("data_type", "data_length", "data_precision", "nullable")


def column_drift(
    columns: DataFrame, sides: Sides, dedupe: bool = False, order: Sequence[str] = ()
) -> DataFrame:
    """Join the two sides on the column's key where a compared attribute differs.

    Equal rows of side 2 are counted before the join, so a column staged many
    times on both sides meets each distinct declaration instead of each row; the
    count comes back as copies. Side 1 joins as it is: it is shuffled once, and
    a key that holds much of it is split by the adaptive skew join.
    """
    if isinstance(sides, InstancePairs):
        return _drift_of_pairs(columns, sides, dedupe, order)
    rows = sides.tag(columns, own_only=True).where(all_present(KEYS)).select("side", *KEYS, *COMPARED)
    left = rows.where("side = 1").drop("side").alias("l")
    right = rows.where("side = 2").groupBy(*KEYS, *COMPARED).agg(F.count("*").alias("_copies")).alias("r")
    if dedupe:
        left = left.distinct().alias("l")
    same_key = F.expr(" AND ".join(f"l.{k} = r.{k}" for k in KEYS))
    joined = left.join(right, same_key & differs("l", "r", COMPARED))
    found = joined.selectExpr(*[f"l.{k} AS {k}" for k in KEYS], *_shown(), "_copies")
    return sides.labelled(_finished(found, dedupe, order), *SHOWN)


def _shown() -> list[str]:
    return [f"{side}.{name} AS {name}_{number}" for name in SHOWN for number, side in ((1, "l"), (2, "r"))]


def _finished(found: DataFrame, dedupe: bool, order: Sequence[str]) -> DataFrame:
    if not dedupe:
        return repeat_rows(found, "_copies", order=order)
    found = found.drop("_copies").distinct()
    return found.orderBy(*order) if order else found


def _drift_of_pairs(columns: DataFrame, sides: InstancePairs, dedupe: bool, order: Sequence[str]) -> DataFrame:
    """Declarations are counted per instance, and only those of pairs that differ meet."""
    rows = sides.nodes(columns).where(all_present(KEYS))
    counted = rows.groupBy(*KEYS, *COMPARED, "node").agg(F.count("*").alias("_n"))
    unequal = " OR ".join(f"l.{n} <> r.{n}" for n in COMPARED)
    found = pairs.differing(counted, KEYS, COMPARED, unequal, sides.edges, sides.small)
    return _finished(found.selectExpr("pair_id", *KEYS, *_shown(), "_copies"), dedupe, order)
