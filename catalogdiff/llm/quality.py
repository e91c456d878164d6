"""Repetition coverage: how much of a text lies inside n-grams and lines it repeats.

For several n, every window of n words gets a rolling hash in numpy; windows whose
hash occurs again in the same text are duplicated, the words they cover are
marked by the running sum of a difference array, and the characters of marked
words are measured against all. Duplicate lines are measured likewise. Nothing crosses
texts, so there is no shuffle, and memory is that of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The largest share of characters inside duplicated n-grams by n, and inside
# duplicate lines, as published for MassiveText (Rae and others, 2021).
MOST_IN_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_IN_LINES = 0.20

SYMBOLS = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# White space to Python's split() that is part of a word here.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BASE = np.uint64(0x9E3779B97F4A7C15)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words")


def covered(words: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` that occurs twice or more, the first one included.

    ``words`` are 64-bit hashes; a window's hash is their polynomial modulo 2^64.
    """
    count = len(words) - n + 1
    if count < 2:
        return np.zeros(len(words), bool)
    rolled = np.zeros(count, np.uint64)
    for i in range(n):
        rolled = rolled * BASE + words[i : i + count]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    again = np.zeros(count, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:count] += again
    edge[n:] -= again
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, sizes: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """``MEASURES`` of a text, and the characters of words inside duplicated n-grams of each size."""
    text = text or ""
    split = WORD.findall if OTHER_SPACE.search(text) else str.split
    words = split(text)
    if not words:
        return [0, 0, len(SYMBOLS.findall(text)), 0, 0, 0], [0] * len(sizes)
    chars = np.fromiter(map(len, words), np.int64, len(words))
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    # Small numbers spread over 64 bits, so that polynomials of them don't meet by chance.
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ codes >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    codes ^= codes >> np.uint64(29)
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, split(line)))
        elif WORD.search(line):
            seen.add(line)
    marks, mark = {}, np.ones(1, bool)
    for n in sorted({8, *sizes}):
        # A window that occurs again has shorter ones that do, so after none there are no more.
        mark = covered(codes, n) if mark.any() else np.zeros(len(words), bool)
        marks[n] = mark
    values = [len(words), int(chars.sum()), len(SYMBOLS.findall(text)), dup_lines, dup_chars, int(marks[8].sum())]
    return values, [int(chars[marks[n]].sum()) for n in sizes]


def coverage(docs: DataFrame, sizes: tuple[int, ...] = tuple(MOST_IN_NGRAMS)) -> DataFrame:
    """``doc_id``, ``MEASURES`` and ``chars_in_<n>`` of every row of ``docs``.

    A NULL or empty text has no words. Rows that repeat are measured each, a NULL doc_id stays, other
    columns are not read, and an empty table gives no rows.
    """
    sizes = tuple(sizes)
    names = ["doc_id", *MEASURES, *(f"chars_in_{n}" for n in sizes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(chain(*measure(t.as_py(), sizes))) for t in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def judged(
    docs: DataFrame, in_ngrams: Mapping[int, float] = MOST_IN_NGRAMS, in_lines: float = MOST_IN_LINES,
    least_words: int = 20, most_repeated: int = 30,
) -> DataFrame:
    """``coverage`` with ``base_failed`` and ``kept``.

    A text fails the base if it has fewer than ``least_words`` words or more than
    ``most_repeated`` percent of them lie in repeated windows of eight. It is kept if it
    passes that, and of its characters no larger share lies in duplicated n-grams, or in duplicate
    lines, than the tables allow. Shares are compared as whole numbers of characters in a thousand.
    """
    found = coverage(docs, tuple(in_ngrams))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    good = 1000 * F.col("dup_line_chars") <= round(1000 * in_lines) * F.col("word_chars")
    for n, most in in_ngrams.items():
        good &= 1000 * F.col(f"chars_in_{n}") <= round(1000 * most) * F.col("word_chars")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
