"""Helpers the operators share: tables written in the shared folder, words, rows in id order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a word is in every operator, as a pattern for Spark and the white space that ends it.
WORD = r"[^\x20\x09-\x0D]+"

# Texts of more bytes than this are read in pieces by the operators that walk through words.
PIECE = 1 << 20

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: computed once, and no longer tied to an executor."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# Rows of a batch that holds texts, sets or signatures: a tenth of Spark's own number, as each task has several batches at once.
BATCH = 1_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For tables that are ``written`` meanwhile: batches of ``BATCH`` rows at most; the session's own bound comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, BATCH) if before > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Keys that are joined by broadcast because many rows have them: at most so many, of at least so many rows.
HOT_KEYS, HOT_ROWS = 10_000, 200


def spread_join(rows: DataFrame, table: DataFrame, key: str, copies: str | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key``, however many rows share one; ``how`` may be ``left``.

    The keys of most rows are broadcast, ``HOT_KEYS`` of them at most, so rows of such a key stay where they are; any other key
    has less than that share of all rows, and goes through a plain join. ``copies`` is the column of ``table`` with the
    rows of a key, which are counted where there is none. Both sides are read twice and should be stored tables.
    """
    counted = table
    if copies is None:
        counted = table.join(rows.groupBy(key).agg(F.count("*").alias("_copies")), key)
    weight = F.col(copies or "_copies")
    hot = counted.where(weight >= HOT_ROWS).orderBy(weight.desc(), key).limit(HOT_KEYS).select(*table.columns)
    hot = written(hot, "hot-keys")
    there = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, how)
    return there.unionByName(others)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def word_pieces(data: bytes, keep: int, piece: int = PIECE) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text in lists, each with the last ``keep`` words of the one before in front.

    The flag tells the first list, whose front is its own. A list has more than ``keep`` words, or is
    the first and ends the text. Bounds memory on very long texts. Bytes split at exactly the white space that ``WORD`` leaves out.
    """
    if len(data) <= piece:
        yield data.split(), True
        return
    at, tail, first = 0, [], True
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words, at = tail + data[at:end].split(), end
        if len(words) > keep or (first and at == len(data)):
            yield words, first
            words, first = (words[-keep:] if keep else []), False
        tail = words


def cut_points(keys: DataFrame, column: str, ranges: int) -> list:
    """At most ``ranges - 1`` values that cut the distinct keys into ranges of similar size.

    They are the keys of smallest hash, so reruns agree and only that many values
    reach the driver.
    """
    if ranges < 2:
        return []
    found = keys.where(F.col(column).isNotNull()).select(column).distinct()
    taken = found.orderBy(F.xxhash64(column), column).limit(ranges - 1).collect()
    return sorted(row[0] for row in taken)


def range_number(column: Column, cuts: Sequence, kind: str) -> Column:
    """Cut points at or below a value, by halving; NULL is in range -1."""
    if not cuts:
        return F.when(column.isNull(), -1).otherwise(0)
    below = F.lit(0)
    # A balanced tree of comparisons: each row passes log2 of them.
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(cuts[middle]).cast(kind), tree(middle + 1, high)).otherwise(tree(low, middle))

    below = tree(0, len(cuts))
    return F.when(column.isNull(), -1).otherwise(below)


def numbered(keys: DataFrame, column: str, kind: str, ranges: int = 64) -> DataFrame:
    """Distinct keys with ``rank`` from 0 in order, NULL last.

    One window over all keys would be one task, so ranges are numbered apart and
    shifted by the sizes of the ranges before, a table of at most ``ranges + 1`` rows.
    """
    cuts = cut_points(keys, column, ranges)
    number = F.when(F.col(column).isNull(), len(cuts) + 1).otherwise(range_number(F.col(column), cuts, kind))
    keys = keys.withColumn("_range", number)
    sizes = keys.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return (
        keys.withColumn("_inside", inside)
        .join(F.broadcast(shifts), "_range")
        .withColumn("rank", (F.col("_shift") + F.col("_inside") - 1).cast("bigint"))
        .drop("_range", "_inside", "_shift")
    )
