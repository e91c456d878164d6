"""Mixing sources to target weights by capped water-filling.

Every source is to get its weight's share of all words, but no more than a number
of epochs over what it has; what it cannot take is shared out again by
weight until no target is above its cap. The targets are met by whole
repetitions of every document and one more of a seeded part of them.

All of it is DataFrame operations: the loop over clamped sources brings three
numbers a round to the driver, however many sources there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogdiff.llm.common import numbered, word_count, written

# Hex digits of the draw that cut a source into cells: 4,096 of them, so that a source with a
# third of all rows is still summed up in thousands of tasks.
CELL_DIGITS = 3


def draw(key: Column, seed: int) -> Column:
    """Where a document stands in its source's seeded order: hex digits that any engine gives."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def weighted(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add ``weight``: the weights repeating over the sources by code point, NULL last."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = numbered(sources, "source", "string")
    return ranked.withColumn("weight", cycle[(F.col("rank") % len(weights)).cast("int")]).drop("rank")


def water_fill(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """Add ``target`` to ``sources (source_size, weight)``.

    A round shares what is left by the weights of sources that are not clamped and clamps
    those that would get more than their cap. The level only rises, so a clamped
    source stays clamped, and the last level says which ones are.
    """
    if epochs < 1:
        raise ValueError("below one epoch the targets cannot add up to all words")
    cap, weight = F.col("source_size") * epochs, F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, None
    while True:
        full = weight * F.lit(level) >= cap if clamped is not None else F.lit(False)
        taken, rest, count = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)),
            F.count_if(full),
        ).first()
        if count == clamped or rest == 0:
            break
        level, clamped = (total - taken) / rest, count
    level = F.lit(level).cast("double")
    return sources.withColumn("target", F.when(weight * level >= cap, cap.cast("double")).otherwise(weight * level))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: int = 7, size: Column | None = None
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of ``docs``.

    ``size`` is a document's words unless another measure is given. A document is taken
    ``floor(target / source_size)`` times, and those first in the source's seeded
    order once more, as far as brings the source nearest to its target. That
    order depends on doc_id only, so reruns agree; rows that repeat a doc_id
    stand next to each other and are taken for themselves. NULL sources are one source, a NULL or
    empty text has size 0, and a source without words has target 0. Texts of any length are counted whole, other
    columns are not read, whatever their names, and an empty table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select("doc_id", "source", size.alias("size"), draw(F.col("doc_id"), seed).alias("draw"))
    rows = written(rows, "sizes")
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = written(water_fill(written(weighted(sources, weights), "weights"), epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("bigint"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight")

    # Words before a document in its source's order: those of the cells before, and those in its own.
    rows = rows.withColumn("cell", F.substring("draw", 1, CELL_DIGITS))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).drop("cell_size")
    cells = cells.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    cells = cells.withColumnsRenamed({"source": "of", "cell": "in"})
    inside = Window.partitionBy("source", "cell").orderBy("draw", "doc_id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", upto)
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("in")))
    # Taken where more than half of the document lies below the target; the order's sum then ends nearest to it.
    middle = F.col("ahead") + F.col("upto") - F.col("size") / 2
    copies = F.col("whole") + F.when(middle < F.col("rest"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; all columns stay.

    A row's decision is found again by doc_id, source and size. Rows that
    agree in all three stand next to each other in the order; the copies taken of them
    are dealt out evenly, those left over to the first by hash of the row.
    """
    options.setdefault("size", word_count(F.col("text")))
    plan = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", options["size"].alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & F.col("source").eqNullSafe(F.col("p_source"))
    rows = rows.join(plan, same & (F.col("size") == F.col("p_size")))
    # Only rows that repeat have to be told apart.
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("row")))
    each, over = F.floor(F.col("p_copies") / F.col("p_rows")), F.col("p_copies") % F.col("p_rows")
    again = rows.where("p_rows > 1").withColumn("copies", each + F.when(place <= over, 1).otherwise(0))
    once = rows.where("p_rows = 1").withColumn("copies", F.col("p_copies"))
    rows = once.unionByName(again).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
