"""Interaction audit of filters: what each one removes, behind every order of the others.

**Mask cells.** A document fails a set of filters, its mask. Documents are counted by part, mask and labels, and nothing
after that depends on how many there are: a part has at most 2^n cells.

**Enumeration.** A recursive CTE extends each prefix of filters by every letter it has not used, joins the part's
cells, and carries the bits applied so far. Each level emits the metrics of its last step: a part has one row per prefix (325
for five filters), and the n! orders then look up their prefixes by equal text.

**Copies.** That a text repeats a smaller doc_id's is known per digest of the text. Rows are counted by document
first and by digest then, both combined before their exchange, so a text that a third of all rows share is a few
rows to the task it lands in.

Odd rows: a NULL text is an empty one, a NULL lang the part ``''``. A row without doc_id has no label, compares with no doc_id
and so never fails as a copy nor makes another fail. Rows that repeat a doc_id are documents of
their own which have no smaller doc_id among them. Several labels of one doc_id count as 1 if any is. Very long
texts are read whole in one row. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogdiff.llm.common import written

# White space between words; symbols that a text should not hold; a letter's share in capitals.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Most filters: the orders of nine are 362,880 a part.
MOST_FILTERS = 9


def _few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def _few_different_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def _many_capitals(text: Column, words: Column) -> Column:
    length = F.char_length(text)
    return 100 * (length - F.char_length(F.translate(text, CAPITALS, ""))) > 10 * length


def _symbols(text: Column, words: Column) -> Column:
    return text.rlike(SYMBOLS)


# Filters by letter: whether a text fails, given the text and its words. The letter COPY is the one that fails copies.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": _few_words, "B": _few_different_words, "C": _many_capitals, "D": _symbols,
}
COPY = "E"


def mask_cells(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, copy: str = COPY
) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by part, failed filters and labels.

    Bit i of the mask is the i-th letter of ``filters``, the last bit is ``copy``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    rows = rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))

    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    # Rows without doc_id meet no label, so they are dealt out by their text.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("label_of"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.withColumn("no_salt", F.lit(0).cast("bigint"))
    rows = rows.join(marks, F.expr("doc_id = label_of AND salt = no_salt"), "left")
    marked = [F.coalesce(name, F.lit(0)).alias(name) for name in ("good", "toxic")]
    cells = rows.groupBy("digest", "part", "mask", *marked).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("low"),
        F.min_by("n", "doc_id").alias("at_low"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
    )
    # A digest has one cell per part and labels, so its window is a few rows however often the text is repeated.
    first = F.min("low").over(Window.partitionBy("digest"))
    cells = cells.withColumn("fresh", F.col("unnamed") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0))
    both = "array(struct(mask AS mask, fresh AS n), struct(mask | {bit} AS mask, n - fresh AS n))".format(bit=1 << len(filters))
    cells = cells.selectExpr("part", "good", "toxic", f"inline({both})")
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


# One row per part and prefix. Sums over a part's cells are folds over at most 2^n structs.
WALK = """
WITH RECURSIVE walk(part, prefix, step, letter, bits, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
    SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {packed}
    UNION ALL
    SELECT part, prefix || letter, step, letter, bits | bit,
           aggregate(cells, 0L, (s, c) -> s + IF(c.mask & (bits | bit) = 0, c.n, 0L)),
           aggregate(cells, 0L, (s, c) -> s + IF(c.mask & bit <> 0 AND c.mask & bits = 0, c.n, 0L)),
           aggregate(cells, 0L, (s, c) -> s + IF(c.mask & bit <> 0 AND c.mask & bits <> 0, c.n, 0L)),
           aggregate(cells, 0L, (s, c) -> s + IF(c.mask = bit, c.n, 0L)),
           aggregate(cells, 0L, (s, c) -> s + IF(c.mask & bit <> 0 AND c.mask & bits = 0, c.good, 0L)),
           aggregate(cells, 0L, (s, c) -> s + IF(c.mask & bit <> 0 AND c.mask & bits = 0, c.toxic, 0L))
    FROM (
        SELECT part, prefix, step, bits, cells, substr({letters}, place, 1) AS letter, shiftleft(1, place - 1) AS bit
        FROM (
            SELECT w.part, w.prefix, w.step + 1 AS step, w.bits, p.cells,
                   explode(filter(sequence(1, {n}), i -> w.bits & shiftleft(1, i - 1) = 0)) AS place
            FROM walk w JOIN {packed} p ON w.part = p.part
            WHERE w.step < {n}
        )
    )
)
SELECT * FROM walk WHERE step > 0
"""


def enumerated(cells: DataFrame, letters: str) -> DataFrame:
    """The audit of ``cells (part, mask, good, toxic, n)``: a row per part, order of ``letters`` and step."""
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"letters are 1 to {MOST_FILTERS} different ones")
    spark = cells.sparkSession
    by_mask = cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    packed = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    packed = written(packed, "audit-cells")
    # The session's bound on rows of a recursion is for runaway ones; this one's rows are known.
    limit, rows = "spark.sql.cteRecursionRowLimit", packed.count() * sum(factorial(n) // factorial(n - k) for k in range(n + 1))
    before = spark.conf.get(limit, None)
    try:
        spark.conf.set(limit, str(rows + 1))
        walk = written(spark.sql(WALK, packed=packed, letters=letters, n=n), "audit-walk")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)

    # A prefix of k letters begins (n - k)! orders.
    orders_of = F.element_at(F.array(*[F.lit(factorial(n - k)).cast("bigint") for k in range(1, n + 1)]), F.col("step"))
    shares = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = walk.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"))
    orders = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("at"))
    orders = orders.withColumn("prefix", F.expr("substr(filter_order, 1, at)")).drop("at")
    metrics = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return orders.join(walk, ["part", "prefix"]).join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", *metrics, "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the step's metrics, for every order of the filters A to E over ``docs``."""
    return enumerated(mask_cells(docs, labels), "".join((*FILTERS, COPY)))
