"""Ranked lexical search: one scan of the documents with an automaton of all item terms.

**Automaton.** The terms of all items are an Aho-Corasick automaton, each guarded by a space on both sides. A
document is brought to terms between single spaces (A-Z lowered, everything that is no term a space), so a
guarded term is found where a whole term stands, and nowhere else. The scan counts tf straight from the text: no
postings of documents are built, and a term that no item has costs only the steps over its letters.

**Two steps.** The first scan gives the counts of each document's item terms, and their sums N, L and df, which are as many
numbers as items have terms. The second turns counts into scores: the automaton's numbers map to the items that hold
the term. Each task keeps the best of each item, which are ranked by item and salt, then by item.

**Bound.** An automaton is broadcast, so items are dealt to as many blocks as keep the text of one block's terms below
``BLOCK_BYTES``, and each block is a scan of its own.

Odd rows: a NULL text has no terms, like one without any, and is in no count. A NULL item text has no terms, and items without
terms or without a match give no rows. Items that repeat an item_id, or have none, are ranked as one item each:
the terms of all rows of an item_id count together. Documents that repeat a doc_id are documents of their own, each with
its rank; one without doc_id comes behind others of its score. Texts of any length are scanned in pieces cut between
terms. An empty table of either kind gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogdiff.llm.common import PIECE, written

# Constants of the score. A term's weight in thousandths, tf in units, k1 of 8 parts, b in hundredths.
WEIGHT, UNIT, STEP, K1, B = 1000, 1_000_000_000, 1000, 8, 75
# Bytes of term text in one automaton; salts that the best of an item are ranked by before they meet.
BLOCK_BYTES, SALTS = 8 << 20, 64

# Bytes of UTF-8 as terms see them: ASCII letters and digits and all bytes beyond ASCII are a term's, capitals are lowered.
_LOWERED = bytes(
    b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isalpha() else 32 for b in range(256)
)
_SEVERAL = re.compile(b"  +")


def spaced(text: str | None, piece: int = PIECE) -> Iterator[bytes]:
    """The terms of a text, each between single spaces, in pieces that cut no term."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        if part := data[at:end].strip(b" "):
            yield b" " + _SEVERAL.sub(b" ", part) + b" "
        at = end


def terms(text: str | None) -> list[bytes]:
    return [t for part in spaced(text) for t in part.split()]


class Automaton:
    """Numbers of the given terms in a document, and how many terms it has in all."""

    def __init__(self, names: list[bytes]):
        self.found = ahocorasick.Automaton()
        for number, name in enumerate(names):
            # Bytes as characters one to one: the automaton takes text.
            self.found.add_word(f" {name.decode('latin-1')} ", number)
        self.found.make_automaton()

    def counts(self, text: str | None) -> tuple[int, Counter]:
        seen, n = Counter(), 0
        for part in spaced(text):
            n += part.count(b" ") - 1
            seen.update(number for _, number in self.found.iter(part.decode("latin-1")))
        return n, seen


def _blocks(items: DataFrame) -> list[list[tuple[int | None, Counter]]]:
    """Items with the counts of their terms, in blocks of bounded text."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = []
    for block in range(blocks):
        some: dict[int | None, Counter] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            some.setdefault(row["item_id"], Counter()).update(terms(row["text"]))
        out.append(sorted(some.items(), key=lambda x: (x[0] is None, x[0])))
    return out


COUNTS = "doc_id bigint, n bigint, numbers binary, tfs binary"


def _counted(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """``doc_id, n, numbers, tfs``: of each document with terms, the numbers of the given ones in it and their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            ids, ns, numbers, tfs = [], [], [], []
            for doc, text in zip(*(batch.column(i) for i in (0, 1))):
                n, seen = automaton.counts(text.as_py())
                if n:
                    ids.append(doc.as_py())
                    ns.append(n)
                    some = sorted(seen)
                    numbers.append(np.array(some, "<i4").tobytes())
                    tfs.append(np.array([seen[i] for i in some], "<i8").tobytes())
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip((ids, ns, numbers, tfs), kinds)], ["doc_id", "n", "numbers", "tfs"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(held, minlength=size)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["number", "df"])

    out = np.zeros(size, np.int64)
    found = counted.select("numbers").mapInArrow(run, "number int, df bigint").groupBy("number").agg(F.sum("df").alias("df"))
    for number, df in found.collect():
        out[number] = df
    return out


def _ranked(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` highest-scoring of ``docs (doc_id, text)`` for each of ``items (item_id, text)``.

    Equal scores are ranked by doc_id. With N documents that hold a term, L terms in them, n in one and df documents
    that hold a term, its weight w is floor(1000 ln((2N+2)/(2df+1))), a document's m is 100-75+((75*n*N) div L), and
    its score sums w*((1000000000*tf) div (1000*tf+8*m)) over the item's terms, repeats included.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id bigint, score bigint, doc_id bigint")
    for block in _blocks(items):
        if any(some for _, some in block):
            found = found.unionByName(_search_block(docs, block, most))
    salted = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), ["item_id", "salt"], most)
    return _ranked(salted.drop("rank", "salt"), ["item_id"], most).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: list[tuple[int | None, Counter]], most: int) -> DataFrame:
    spark = docs.sparkSession
    names = sorted({t for _, some in items for t in some})
    counted = written(_counted(docs, names), "item-terms")
    documents, total = counted.agg(F.count("*"), F.sum("n")).first()
    df = _frequencies(counted, len(names))
    # Terms to items: the places of a term's items, and how often each holds it.
    place = {t: i for i, t in enumerate(names)}
    held = sorted((place[t], at, times) for at, (_, some) in enumerate(items) for t, times in some.items())
    starts = np.searchsorted([h[0] for h in held], np.arange(len(names) + 1))
    where, times = (np.array([h[i] for h in held], np.int64) for i in (1, 2))
    weight = np.array([int(WEIGHT * np.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    shared = spark.sparkContext.broadcast((starts, where, times, weight, [item for item, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, where, times, weight, ids = shared.value
        kept = _Best(len(ids), most)
        for batch in batches:
            for doc, n, numbers, tfs in zip(*(c.to_pylist() for c in batch.columns)):
                numbers, tf = np.frombuffer(numbers, "<i4"), np.frombuffer(tfs, "<i8")
                m = 100 - B + (B * n * documents) // total
                part = weight[numbers] * ((UNIT * tf) // (STEP * tf + K1 * m))
                widths = starts[numbers + 1] - starts[numbers]
                # The items of all terms one behind the other.
                at = np.repeat(starts[numbers] - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
                scores = np.zeros(len(ids), np.int64)
                np.add.at(scores, where[at], times[at] * np.repeat(part, widths))
                kept.add(doc, scores)
        yield kept.rows(ids)

    return counted.mapInArrow(run, "item_id bigint, score bigint, doc_id bigint")


class _Best:
    """The highest scores of each item that a task has met: two tables of ``most`` columns, and each item's least score to beat."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.zeros(items, np.int64)
        self.best: list[list[tuple[int, bool, int | None]]] = [[] for _ in range(items)]

    def add(self, doc: int | None, scores: np.ndarray) -> None:
        for item in np.nonzero((scores > 0) & (scores >= self.least))[0].tolist():
            # Higher scores first, then smaller doc_ids, then rows without one.
            some = self.best[item]
            some.append((-int(scores[item]), doc is None, doc or 0))
            if len(some) >= 2 * self.most:
                some.sort()
                del some[self.most :]
                self.least[item] = -some[-1][0]

    def rows(self, ids: list[int | None]) -> pa.RecordBatch:
        out = [(ids[i], -s, None if none else d) for i, some in enumerate(self.best) for s, none, d in sorted(some)[: self.most]]
        columns = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "score", "doc_id"])
