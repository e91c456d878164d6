"""Near duplicates by SimHash, found at the codewords of a covering code.

**Anchors.** The 64 bits are three blocks of 23, 23 and 18 bits, the last with five
zeros put behind it. Every block is covered by the perfect Golay code of length
23: any word is within three bits of exactly one of its 4,096 codewords. Triples
of codewords, 2^36 in all, are the anchors, and their covering radius is 3 in
each block.

**Replicas.** Two fingerprints that differ in at most 4 bits have a midpoint at
most 2 bits from both. The midpoint's own anchor lies within the covering radius of
it, so both fingerprints lie, block by block, at most 2 bits in all beyond the
radius of that anchor. A fingerprint goes to every such anchor, about 120 of
them, so no link is lost; half the threshold beyond the radius is enough.

**Per anchor.** An anchor's fingerprints are compared in blocks, and a block gives
the edges of a spanning forest rather than its pairs. Unrelated fingerprints
rarely share one of 2^36 anchors. An anchor with more than a block of fingerprints
is cut into blocks, and pairs of blocks are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogdiff.llm.common import spread_join, word_pieces, written

# The generator polynomial of the binary Golay code of length 23,
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
LENGTH, CHECK = 23, 11
SHIFTS = (0, 23, 46)

SHINGLE, SEED, THRESHOLD = 4, 42, 4
# Fingerprints of one anchor that are compared in one piece.
BLOCK = 2048


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of ``width`` words, A-Z in lower case, piece by piece.

    A text of fewer words is one shingle, a text without words none.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    for words, first in word_pieces(data, width - 1):
        if len(words) < width:
            if not first or not words:
                continue
            hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            digest = xxhash.xxh64_intdigest
            spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
            hashes = [digest(line[a:b], seed) for a, b in spans]
        yield np.array(hashes, "<u8")


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the shingles of ``width`` words, A-Z in lower case; 0 for a text without words.

    A text of fewer words is one shingle.
    """
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every whole text; the fingerprint's bits are a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), width, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


@lru_cache(1)
def covering() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: error patterns by their cost beyond the radius, and how many there are.

    ``patterns[s, cost]`` are the words of weight at most 3 (cost 0, exactly one),
    4 (cost 1) or 5 (cost 2) with syndrome ``s``: a word's codewords at that
    cost are the word with one of them flipped.
    """
    basis = []
    for bit in range(LENGTH):  # x^bit modulo the generator
        word = 1 << bit
        for high in range(LENGTH - 1, CHECK - 1, -1):
            if word >> high & 1:
                word ^= GOLAY << (high - CHECK)
        basis.append(word)
    words, syndromes, costs = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    layer, last, syndrome = np.zeros(1, np.int64), np.full(1, -1), np.zeros(1, np.int64)
    for weight in range(1, 6):
        parts = [(layer[last < b] | 1 << b, np.full((last < b).sum(), b), syndrome[last < b] ^ basis[b]) for b in range(LENGTH)]
        layer, last, syndrome = (np.concatenate(x) for x in zip(*parts))
        words.append(layer)
        syndromes.append(syndrome)
        costs.append(np.full(len(layer), max(0, weight - 3)))
    words, syndromes, costs = map(np.concatenate, (words, syndromes, costs))
    counts = np.zeros((1 << CHECK, 3), np.int64)
    np.add.at(counts, (syndromes, costs), 1)
    patterns = np.zeros((1 << CHECK, 3, counts.max()), np.int64)
    order = np.lexsort((words, costs, syndromes))
    group = syndromes[order] * 3 + costs[order]
    place = np.arange(len(order)) - np.searchsorted(group, group)
    patterns[syndromes[order], costs[order], place] = words[order]
    return patterns, counts


@lru_cache(1)
def _syndrome_table() -> np.ndarray:
    """Syndromes of all 23-bit words, built by doubling; two bytes each, as a worker keeps them."""
    table = np.zeros(1, np.int16)
    for bit in range(LENGTH):
        word = 1 << bit
        for high in range(LENGTH - 1, CHECK - 1, -1):
            if word >> high & 1:
                word ^= GOLAY << (high - CHECK)
        table = np.concatenate((table, table ^ np.int16(word)))
    return table


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions into ``fps`` and the anchors they go to: all within the radius plus 2 bits in all."""
    patterns, counts = covering()
    bits = fps.astype(np.uint64)
    near = []  # per block and cost: codewords' free bits (n, most), and which of them there are
    for shift in SHIFTS:
        block = (bits >> np.uint64(shift) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        syndrome = _syndrome_table()[block]
        by_cost = []
        for cost in range(3):
            most = int(counts[:, cost].max())
            code = (block[:, None] ^ patterns[syndrome, cost, :most]) >> CHECK
            by_cost.append((code, np.arange(most) < counts[syndrome, cost][:, None]))
        near.append(by_cost)
    where, keys = [], []
    for a in range(3):
        for b in range(3 - a):
            for c in range(3 - a - b):
                (x, xs), (y, ys), (z, zs) = near[0][a], near[1][b], near[2][c]
                key = x[:, :, None, None] << 24 | y[:, None, :, None] << 12 | z[:, None, None, :]
                there = xs[:, :, None, None] & ys[:, None, :, None] & zs[:, None, None, :]
                where.append(np.nonzero(there)[0])
                keys.append(key[there])
    return np.concatenate(where), np.concatenate(keys)


def _forest(fps: np.ndarray, threshold: int, split: int | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints that differ in at most ``threshold`` bits.

    With ``split`` only pairs across that position are looked at. Rows are
    compared one against the rest, so memory is one row's.
    """
    n, edges = len(fps), []
    values, fps = fps.tolist(), fps.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    if split is None:
        seen = np.zeros(n, bool)
        for start in range(n):  # breadth first, so every fingerprint is compared with the unseen ones once
            if seen[start]:
                continue
            seen[start], queue = True, [start]
            while queue:
                at = queue.pop()
                rest = np.nonzero(~seen)[0]
                near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= threshold]
                seen[near] = True
                queue.extend(near.tolist())
                edges.extend((values[at], values[i]) for i in near.tolist())
        return edges
    left, right = fps[:split], fps[split:]
    free_left, free_right = np.ones(len(left), bool), np.ones(len(right), bool)
    for start in range(len(left)):
        if not free_left[start]:
            continue
        free_left[start], queue = False, [(0, start)]
        while queue:
            side, at = queue.pop()
            own, other, free = (left, right, free_right) if side == 0 else (right, left, free_left)
            mine, theirs = (0, split) if side == 0 else (split, 0)
            rest = np.nonzero(free)[0]
            near = rest[np.bitwise_count(other[rest] ^ own[at]) <= threshold]
            free[near] = False
            queue.extend((1 - side, i) for i in near.tolist())
            edges.extend((values[mine + at], values[theirs + i]) for i in near.tolist())
    return edges


def _compare(batches: Iterator[pa.RecordBatch], threshold: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: edges of small anchors, and the blocks of large ones, kept for later."""
    names = ["a", "b", "anchor", "part", "members"]

    def out(edges: list, blocks: list) -> pa.RecordBatch:
        rows = [(a, b, None, None, None) for a, b in edges] + [(None, None, *x) for x in blocks]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    anchor, members, part = None, np.zeros(0, np.int64), 0
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        edges, blocks = [], []
        cuts = np.nonzero(keys[1:] != keys[:-1])[0] + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        # Single fingerprints have no partner, save the first and last of a batch, which may go on.
        for i in np.nonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))[0].tolist():
            if keys[starts[i]] != anchor:
                if part:
                    blocks.append((anchor, part, members.tobytes()))
                elif len(members) > 1:
                    edges += _forest(members, threshold)
                anchor, members, part = keys[starts[i]], np.zeros(0, np.int64), 0
            members = np.concatenate((members, fps[starts[i] : ends[i]]))
            while len(members) > block:
                blocks.append((int(anchor), part, members[:block].tobytes()))
                members, part = members[block:], part + 1
        if edges or blocks:
            yield out(edges, [(int(k), p, m) for k, p, m in blocks])
    if part:
        yield out([], [(int(anchor), part, members.tobytes())])
    elif len(members) > 1 and (edges := _forest(members, threshold)):
        yield out(edges, [])


def links(fps: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``a, b``: a spanning set of the links between the distinct fingerprints in ``fp``."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the replicas reach 2 bits beyond the radius, so links of up to 4 bits")

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                some = values[at : at + 4096]
                where, keys = anchors(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[where])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, threshold, block)

    def compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, other = (np.frombuffer(row[c], np.int64) for c in ("members", "members_2"))
                if row["part"] == row["part_2"]:
                    edges = _forest(own, threshold)
                else:
                    edges = _forest(np.concatenate((own, other)), threshold, len(own))
                if edges:
                    a, b = zip(*edges)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    shape = "a bigint, b bigint, anchor bigint, part int, members binary"
    found = fps.select("fp").mapInArrow(replicas, "anchor bigint, fp bigint")
    found = written(found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, shape), "anchors")
    # Blocks of one anchor, each with itself and those before it: a fingerprint's row is in as many
    # rows as its anchor has blocks, and rows are dealt out by the pair, not by the anchor.
    parts = found.where("anchor IS NOT NULL").select("anchor", "part", "members")
    mate = parts.select("anchor", F.col("part").alias("part_2"), F.col("members").alias("members_2"))
    pairs = parts.join(mate, "anchor").where("part_2 <= part").repartition("anchor", "part", "part_2")
    late = pairs.select("part", "members", "part_2", "members_2").mapInArrow(compare_parts, "a bigint, b bigint")
    return found.where("a IS NOT NULL").select("a", "b").unionByName(late)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges (a, b)`` reaches; others are not listed.

    Large and small stars in turn (Kiveris and others, 2014): every node hands
    its larger neighbours to its smallest one, then its smaller neighbours. Both
    are aggregates and joins, rounds grow with the logarithm of the nodes, and
    each round is a table in the shared folder.
    """

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    def stars(rows: DataFrame) -> bool:
        """Whether every node hands to one other that hands to none, which a round would leave as it is."""
        ends = rows.selectExpr("u AS node", "1L AS out", "0L AS into").union(rows.selectExpr("v", "0L", "1L"))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return not ends.agg(F.expr("bool_or(out > 1 OR out > 0 AND into > 0)")).first()[0]

    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    flat = written(flat, "links")
    while not stars(flat):
        both = flat.union(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        flat = written(small, "small-star")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, seed: int = SEED, threshold: int = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest doc_id that is reached over fingerprints
    which differ in at most ``threshold`` bits. NULL texts and texts without words
    have fingerprint 0 and are linked by it. A NULL doc_id names no component,
    so it is NULL where a component has no other. Repeated rows stay rows, texts of any length are
    read whole, in pieces, other columns are not read, an empty table gives no rows.
    """
    found = written(fingerprints(docs, width, seed), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    linked = components(links(nodes, threshold, block))
    linked = written(linked.join(nodes, linked["node"] == nodes["fp"]).select("node", "root", "first"), "linked")
    roots = linked.groupBy("root").agg(F.min("first").alias("reached"), F.count("*").alias("members"))
    linked = spread_join(linked.drop("first"), written(roots, "roots"), "root", "members")
    linked = linked.select(F.col("node").alias("fp"), "reached")
    named = nodes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("reached", "first").alias("component_id"))
    # A fingerprint that many rows share, that of texts without words among them, is not brought to one task.
    return spread_join(found, written(named, "named"), "fp", "copies").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` with one document of every near-duplicate group: the one of smallest doc_id.

    All columns stay. Rows that repeat a doc_id count as one document, of which the row
    with the smallest hash over all columns stays. Rows without doc_id cannot be
    named and stay as they are.
    """
    return first_rows(docs, near_duplicates(docs, **options))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id names its component in ``found (doc_id, component_id)``, one each, and those without doc_id."""
    found = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"))
    kept = rows.join(found.select(F.col("doc_id").alias("key")), "key", "left_semi")
    first = Window.partitionBy("key").orderBy(F.xxhash64("row"), F.to_json("row"))
    kept = kept.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))
