"""Catalog extracts: pipe-delimited CSV files routed to a table by their name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogdiff.schemas import STAGED, conform

# The CSV dialect, the place of the table in a file name
# (``<prefix>__<table>__data.csv``) and the marks of files that are not loaded.
DELIMITER = "|"
NAME_SEPARATOR = "__"
SKIPPED_MARKS = ("defines", "eoj")


def _extract_name(path: Column) -> Column:
    """An extract is a file, or a folder of that name with the parts Spark wrote. Of each row, so without a pattern."""
    last = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.when(last.startswith("part-") & path.contains("/"), folder).otherwise(last)


def _table_name(name: Column) -> Column:
    """The second part of an extract's name; NULL where there is none."""
    return F.when(name.contains(NAME_SEPARATOR), F.split_part(name, F.lit(NAME_SEPARATOR), F.lit(2)))


def read_extracts(spark: SparkSession, folder: str, table: str, splittable: bool = False) -> DataFrame:
    """All extracts of one table in a folder.

    Headers are checked against the schema, and a bad record fails the job. A table
    that is not known has the columns of its header, all of them text.
    A quoted field may hold the delimiter, a quote or a line break; only an
    empty field is NULL. Because of
    line breaks a file is one task; ``splittable=True`` cuts big files instead,
    and fails (never misreads) on a record that goes over several lines. Staging
    spreads the rows again either way.
    """
    paths = f"{folder}/*{NAME_SEPARATOR}{table}{NAME_SEPARATOR}*"
    schema = STAGED.get(table)
    if schema is None:
        # The header of one file of this table; the plan fails where another file's differs.
        path = extract_files(spark, folder).where(F.col("name") == table).agg(F.min("path")).first()[0]
        if path is None:
            raise FileNotFoundError(f"no extract of {table} in {folder}")
        header = spark.read.option("header", True).option("sep", DELIMITER).option("quote", '"').option("escape", '"').csv(path)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    reader = spark.read.schema(schema)
    name = _extract_name(F.col("_metadata.file_path"))
    rows = (
        reader.option("header", True)
        .option("enforceSchema", False)
        .option("sep", DELIMITER)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", not splittable)
        .option("mode", "FAILFAST")
        .csv(paths)
        .where(_table_name(name) == table)
    )
    for mark in SKIPPED_MARKS:
        rows = rows.where(~name.contains(mark))
    return rows


def extract_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name`` of the extracts in a folder and their tables; files are listed, not read."""
    pattern = f"{folder}/*{NAME_SEPARATOR}*{NAME_SEPARATOR}*"
    try:
        files = spark.read.format("binaryFile").load(pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "path string, name string")
        raise
    name = _extract_name(F.col("path"))
    for mark in SKIPPED_MARKS:
        files = files.where(~name.contains(mark))
    return files.select("path", _table_name(name).alias("name")).where("name <> ''")


def extract_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables that a folder has extracts of."""
    return sorted(row["name"] for row in extract_files(spark, folder).select("name").distinct().collect())


def write_extract(rows: DataFrame, folder: str, table: str, prefix: str = "catalog") -> None:
    """Write rows as one extract of ``table``, in parts, under the name it is routed by.

    A table that is not known is written with the columns it has.
    """
    name = NAME_SEPARATOR.join((prefix, table, "data.csv"))
    (
        (conform(rows, table) if table in STAGED else rows)
        .write.mode("overwrite")
        .option("header", True)
        .option("sep", DELIMITER)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(f"{folder}/{name}")
    )
