"""Near duplicates of the pipeline: five-word shingles, a Jaccard similarity of 0.8 or more.

Two searches give pairs, and every link is a pair whose whole sets have been compared. SimHash, as in ``simhash``, finds texts whose
fingerprints differ in four bits or fewer; at 0.8 most pairs differ in more, so that it finds the closest ones only. The
inverted join of ``coordinates`` finds the others: at 0.8 fewer than ``MATCHES`` of 64 MinHash values agree
in about one of ten million pairs. Texts are one node by a digest of 128 bits. Here texts
without words are alike, so that one of them stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.llm import coordinates, simhash
from catalogdiff.llm.common import spread_join, written
from catalogdiff.llm.simhash import first_rows

# Similarity from which texts are alike, in hundredths, and words of a shingle; collisions from which a pair is checked.
ALIKE, SHINGLE, MATCHES = 80, 5, 33
# Shingles of a list that are compared in one piece.
BLOCK = coordinates.SHINGLES


def fingerprint_pairs(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: texts of ``nodes (node)`` that SimHash links, of ``rows (node, text)``.

    Texts of one fingerprint are paired with the smallest of them, and these across the links of their fingerprints: pairs grow with the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash._signed(simhash.fingerprint(t.as_py(), SHINGLE)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["node", "fp"])

    found = rows.mapInArrow(run, "node binary, fp bigint").groupBy("node").agg(F.first("fp").alias("fp"))
    found = written(found.join(nodes, "node", "left_semi"), "fingerprints")
    heads = written(found.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("copies")), "distinct")
    same = spread_join(found, heads.where("copies > 1"), "fp", "copies").where("node <> least")
    linked = written(simhash.links(heads.select("fp")), "fingerprint-links")
    linked = linked.join(heads.selectExpr("fp AS a", "least AS one"), "a").join(heads.selectExpr("fp AS b", "least AS two"), "b")
    return same.selectExpr("least AS a", "node AS b").union(linked.selectExpr("least(one, two)", "greatest(one, two)"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest doc_id reached over texts of a similarity of 0.8 or more. A text of fewer
    than five words is one shingle, and texts without words, NULL among them, are alike. A NULL doc_id
    names no component, so it is NULL where a component has no other. Rows that repeat stay rows, texts of any length are
    read whole, an empty table gives no rows, and other columns are not read.
    """
    found = coordinates.near_duplicates(docs, SHINGLE, ALIKE, MATCHES, empty_alike=True, shingles=block, search=fingerprint_pairs)
    return found.select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` with one document of every group of alike ones: the one of smallest doc_id.

    Repeated doc_ids and rows without one are treated as in ``simhash.one_of_each``.
    """
    return first_rows(docs, near_duplicates(docs, **options))
