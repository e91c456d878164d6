"""Hierarchical packing of documents into windows of several lengths.

A document's ids are routed to context-size tiers, longest first: as many whole windows
of the longest tier as they fill, at most one of each shorter tier, and a tail
shorter than the shortest. Pieces of a tier fill a window exactly and need no padding.
Tails are packed best fit, longest first, into windows of the longest tier, and
gaps that a shorter tier's piece fits into are filled from that tier. In each shard
sequences are dealt to step groups, longest first to the lightest group, so that
steps hold about the same number of tokens.

Only pieces' lengths and checksums are shuffled, never ids. Shards are cut by a hash of the
piece, so a very long document is spread over many of them, and each holds a bounded
number of pieces.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.llm.common import HOT_KEYS, HOT_ROWS, written

TIERS = (4096, 2048, 1024, 512)
# Pieces of a shard, and tokens of a step.
SHARD, STEP = 50_000, 32 * 4096
# Words whose ids a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 500_000, 48


@lru_cache(2)
def _tokenizer(path: str):
    # One core is one task's; threads would take those of others.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, which keeps its words from task to task."""
    return Encoder(path)


class Encoder:
    """Token ids of texts, word by word.

    Right for tokenizers that lower the case and never join what white space
    separates: a text's ids are then its words' ids in order, and a word met
    before costs a look-up. A comma or full stop that ends a word of letters is a token of
    its own, so the word before it is looked up without.
    """

    def __init__(self, path: str):
        self._encode = _tokenizer(path).encode_batch
        self._known: dict[bytes, bytes] = {}

    def _ids(self, words: Sequence[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of words. Words of letters are encoded many to a line, which takes little more than half the time."""
        texts = [(w, w.decode("utf-8", "replace")) for w in words]
        plain = [(w, t) for w, t in texts if t.isalpha()]
        other = [(w, t) for w, t in texts if not t.isalpha()]
        for (word, _), found in zip(other, self._encode([t for _, t in other], add_special_tokens=False)):
            yield word, np.array(found.ids, "<u4").tobytes()
        lines = [plain[at : at + 128] for at in range(0, len(plain), 128)]
        joined = self._encode([" ".join(t for _, t in line) for line in lines], add_special_tokens=False)
        for line, found in zip(lines, joined):
            ids = np.array(found.ids, "<u4").tobytes()
            starts = np.cumsum([0, *(len(t) + 1 for _, t in line)])
            ends = np.searchsorted([a for a, _ in found.offsets], starts)
            for (word, _), a, b in zip(line, ends[:-1].tolist(), ends[1:].tolist()):
                yield word, ids[4 * a : 4 * b]

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self._known
        # The names of special tokens are told apart by case, so texts that may hold one keep theirs.
        data = ((t or "").encode("utf-8", "replace") for t in texts)
        split = [(d if b"<|" in d else d.lower()).split() for d in data]
        found = [list(map(known.get, words)) for words in split]
        gaps = [[i for i, ids in enumerate(some) if ids is None] for some in found]
        new = {words[i] for words, holes in zip(split, gaps) for i in holes}
        if new:
            late = self._look_up(new)
            for words, some, holes in zip(split, found, gaps):
                for i in holes:
                    some[i] = late[words[i]]
        return [b"".join(some) for some in found]

    def _look_up(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before; they are remembered as long as there is room."""
        known, late = self._known, {}
        ended = {w: (w[:-1], w[-1:]) for w in new if w[-1:] in (b",", b".") and w[-2:-1].isalpha()}
        needed = {p for parts in ended.values() for p in parts}
        needed.update(w for w in new if w not in ended)
        for part in needed & known.keys():
            late[part] = known[part]
        needed = list(needed.difference(late))
        for at in range(0, len(needed), 65_536):
            late.update(self._ids(needed[at : at + 65_536]))
        for word, (stem, mark) in ended.items():
            late[word] = late[stem] + late[mark]
        for word, ids in late.items():
            if len(known) >= REMEMBERED:
                break
            if len(word) <= LONGEST:
                known[word] = ids
        return late


def cut(total: int, tiers: Sequence[int]) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole windows, one of each shorter tier, the tail."""
    pieces, at = [], 0
    while total - at >= tiers[0]:
        pieces.append((at, tiers[0]))
        at += tiers[0]
    for tier in tiers[1:]:
        if total - at >= tier:
            pieces.append((at, tier))
            at += tier
    return pieces + ([(at, total - at)] if at < total else [])


def pieces(docs: DataFrame, tokenizer: str, end: int, tiers: Sequence[int] = TIERS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of the pieces of every row of ``docs``."""
    tiers, last = tuple(tiers), np.array([end], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            # In small lots, so that a batch of long texts is not held as words all at once.
            for lot in _lots(batch.column(1), 2_000_000):
                rows = []
                texts = batch.column(1).slice(*lot).to_pylist()
                for doc, ids in zip(batch.column(0).slice(*lot).to_pylist(), encode(texts)):
                    ids += last
                    total, view = len(ids) // 4, memoryview(ids)
                    rows += [
                        (doc, at, n, zlib.crc32(view[4 * at : 4 * (at + n)]), total) for at, n in cut(total, tiers)
                    ]
                arrays = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _lots(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, as start and length, of about ``most`` characters or of one row."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text.as_py() or "")
        if i > start and size + n > most:
            yield start, i - start
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts) - start


def pack_shard(lengths: np.ndarray, tiers: Sequence[int] = TIERS, step: int = STEP) -> tuple[list[int], list[int], list[int]]:
    """Sequence number, offset and step group of each piece of a shard."""
    longest = tiers[0]
    exact: dict[int, list[int]] = {t: [] for t in tiers}
    tails = []
    for i, n in enumerate(lengths.tolist()):
        (exact[n] if n in exact else tails).append(i)
    tails.sort(key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), in order
    for i in tails:
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, which = room.pop(at)
        else:
            free, which = longest, len(bins)
            bins.append([])
        bins[which].append(i)
        if free > n:
            insort(room, (free - n, which))
    # Gaps of long windows are filled from shorter tiers, with the longest piece that fits.
    for free, which in room:
        for tier in tiers[1:]:
            while free >= tier and exact[tier]:
                bins[which].append(exact[tier].pop())
                free -= tier
    sequences = [[i] for t in tiers for i in exact[t]] + bins
    sizes = [sum(int(lengths[i]) for i in s) for s in sequences]
    groups = [(0, g) for g in range(-(-sum(sizes) // step))]
    number, offset, group = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    for s in sorted(range(len(sequences)), key=lambda s: (-sizes[s], s)):
        load, lightest = groups[0]
        heapq.heapreplace(groups, (load + sizes[s], lightest))
        at = 0
        for i in sequences[s]:
            number[i], offset[i], group[i] = s, at, lightest
            at += int(lengths[i])
    return number, offset, group


def pack(
    docs: DataFrame, tokenizer: str, end: int = 2, tiers: Sequence[int] = TIERS, shard: int = SHARD, step: int = STEP
) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_group``.

    ``tiers`` are powers of two, longest first; ``tokenizer`` is a tokenizer's file, which every executor
    has under that path. Every id lies in one piece; a NULL or empty text is the
    one id ``end``. Rows that repeat a doc_id are documents of their own, a NULL doc_id stays NULL, other columns
    are not read, and an empty table gives no rows. Shards hold about
    ``shard`` pieces each, whatever ids or texts repeat. ``sequence_id`` and
    ``step_group`` are unique over all shards, not without gaps.
    """
    tiers = tuple(tiers)
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two, longest first")
    cut_rows = written(pieces(docs, tokenizer, end, tiers), "pieces")
    shards = max(1, -(-cut_rows.count() // shard))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # One order whatever the shuffle's was, so that a task that runs again packs the same.
        rows = rows.sort_values(["doc_id", "start", "length", "ids_crc32", "doc_tokens"], kind="stable")
        number, offset, group = pack_shard(rows["length"].to_numpy(), tiers, step)
        first = rows["shard"].to_numpy() << 32
        return rows.drop(columns="shard").assign(
            sequence_id=first + np.array(number), offset=offset, step_group=first + np.array(group)
        )

    # Dealt by all that a piece is; of pieces equal in it, where there are many, by their place in the stored table as well.
    kinds = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    equal = cut_rows.groupBy(F.xxhash64(*kinds).alias("draw")).agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
    hot = written(equal.orderBy(F.desc("n"), "draw").limit(HOT_KEYS).select("draw", F.lit(True).alias("hot")), "equal-pieces")
    dealt = cut_rows.withColumn("draw", F.xxhash64(*kinds)).withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.join(F.broadcast(hot), "draw", "left")
    draw = F.when(F.col("hot"), F.xxhash64("draw", "place")).otherwise(F.col("draw"))
    dealt = dealt.select(*kinds, F.pmod(draw, F.lit(shards)).cast("bigint").alias("shard"))
    # NULL ids pass pandas as a value that no shard is disturbed by.
    dealt = dealt.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    schema = ", ".join(f"{n} bigint" for n in kinds) + ", known boolean, sequence_id bigint, offset bigint, step_group bigint"
    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    doc = F.when(F.col("known"), F.col("doc_id")).alias("doc_id")
    return packed.select(doc, *kinds[1:], "sequence_id", "offset", "step_group")
