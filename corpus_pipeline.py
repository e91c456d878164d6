"""A corpus from ``documents``: toxicity, near duplicates, personal data, mixing, packing.

Each stage works on all rows that the one before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``, extra ones too, whatever their names.

Odd rows: NULL and empty texts are documents like others (not toxic beyond the bias, near duplicates of each other, without
personal data, of size 0, one token). Rows without doc_id stay; of rows that repeat a doc_id one stays. Very long
texts are worked on whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalogdiff.llm import alike, mixing, packing, pii, toxicity
from catalogdiff.llm.common import read_table, written
from catalogdiff.llm.queries import TOXIC_FROM, tokenizer_file, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the model learns from the labelled ones among ``docs``."""
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs, model).where(f"score < {TOXIC_FROM}").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest doc_id.

    Pairs come from SimHash and from an inverted join on MinHash coordinates. Groups are linked by those whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return alike.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in the sequences they are packed into."""
    return packing.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# A fitted classifier and a tokenizer can't be had in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
