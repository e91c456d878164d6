"""Counts per side: one aggregate that counts both sides, combined before its exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.operators import pairs
from catalogdiff.operators.presence import Sides
from catalogdiff.operators.selection import InstancePairs, edge_roles, map_columns, map_owners, map_roles


def count_diff(rows: DataFrame, keys: Sequence[str], sides: Sides, mismatch: bool = False) -> DataFrame:
    """Rows per key and side, 0 where a side has none; ``mismatch`` keeps unequal counts.

    A third instance has no unequal counts, so for these the two compared are read only.
    """
    if isinstance(sides, InstancePairs):
        counted = pairs.totals(pairs.counted_by(sides.nodes(rows), keys), keys, sides.edges, sides.small)
    else:
        counted = sides.tag(rows, own_only=mismatch).groupBy(*keys).agg(
            F.expr("count_if(side = 1) AS count_1"), F.expr("count_if(side = 2) AS count_2")
        )
    return sides.labelled(counted.where("count_1 <> count_2") if mismatch else counted, "count")


def counts_of(finest: DataFrame, keys: Sequence[str], sides: Sides, mismatch: bool = False) -> DataFrame:
    """As ``count_diff``, rolled up from the ``finest`` aggregate over more keys."""
    if isinstance(sides, InstancePairs):
        rolled = finest.groupBy(*keys, "node").agg(F.sum("_n").alias("_n"))
        counted = pairs.totals(rolled, keys, sides.edges, sides.small)
    else:
        counted = finest.groupBy(*keys).agg(F.sum("_r1").alias("count_1"), F.sum("_r2").alias("count_2"))
    return sides.labelled(counted.where("count_1 <> count_2") if mismatch else counted, "count")


def mapped_count_diff(
    rows: DataFrame, key: str, sides: Sides, owner_maps: Sequence[tuple[str, str]]
) -> DataFrame:
    """Rows per key between mapped owners. NULL keys do not meet, so each side keeps its row."""
    maps = map_columns(owner_maps)
    if isinstance(sides, InstancePairs):
        mine = map_roles(sides.nodes(rows), owner_maps)
        mine = mine.withColumn("_loose", F.expr(f"IF({key} IS NULL, node % 2, NULL)"))
        keys = [*maps, key, "_loose"]
        counted = pairs.totals(pairs.counted_by(mine, keys), keys, edge_roles(sides.edges), sides.small)
    else:
        mine = map_owners(sides.tag(rows, own_only=True), owner_maps)
        mine = mine.withColumn("_loose", F.when(F.col(key).isNull(), F.col("side")))
        counted = mine.groupBy(*maps, key, "_loose").agg(
            F.expr("count_if(side = 1) AS count_1"), F.expr("count_if(side = 2) AS count_2")
        )
    return sides.labelled(counted.drop("_loose"), "count")


def line_diff(rows: DataFrame, keys: Sequence[str], lines: str, sides: Sides) -> DataFrame:
    """Keys both sides have whose line counts differ; of duplicates the largest counts."""
    if isinstance(sides, InstancePairs):
        counted = sides.nodes(rows).groupBy(*keys, "node").agg(F.max(lines).alias("lines"), F.lit(1).cast("bigint").alias("_n"))
        found = pairs.differing(counted.where("lines IS NOT NULL"), keys, ["lines"], "l.lines <> r.lines", sides.edges, sides.small)
        return found.selectExpr("pair_id", *keys, "l.lines AS line_count_1", "r.lines AS line_count_2")
    counted = sides.tag(rows, own_only=True).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 1, F.col(lines))).alias("line_count_1"),
        F.max(F.when(F.col("side") == 2, F.col(lines))).alias("line_count_2"),
    )
    return sides.labelled(counted.where("line_count_1 <> line_count_2"), "line_count")
