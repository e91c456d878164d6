"""Near duplicates by an inverted join on MinHash coordinates.

**Postings.** A text is the set of its shingles, as 64-bit hashes, and has 64 MinHash values. Each coordinate with its
value is a token, and a text is posted under its tokens. Two texts of Jaccard similarity s agree in each coordinate
with probability s, so at 0.85 fewer than ``MATCHES`` of 64 agree in 4 of a hundred million pairs.

**Prefix.** Tokens have one order over all texts, rare ones first. Two texts that share ``MATCHES`` tokens share one of
the first ``64 - MATCHES + 1`` of each, so only these are posted. How common a token is comes from a table of
2^20 counters over all tokens, each kept as the logarithm of its count; a counter that several tokens share changes the order
for all texts alike, so it costs postings and loses nothing.

**Skipping.** The other tokens, whose lists are long, are not merged: a pair that meets in a prefix list is
probed for them in its signatures, and is kept at ``MATCHES`` collisions. Sizes whose ratio is below the limit are skipped
unprobed, and so are pairs that meet in an earlier list, or are connected already.

**Check.** A link is a pair whose whole sets have been compared.

**Large lists.** Each list's texts are held against its smallest one first, dealt out by pairs in chunks, so that no key gathers
a list. Only lists that are not one component then are merged in full, in blocks of bounded size and pairs of blocks, each a
group of its own. They give the texts that have a partner to be checked, not the pairs, and the check gives the edges of
a forest, so no step writes the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.llm.common import small_batches, spread_join, written
from catalogdiff.llm.simhash import components, shingle_hashes

# Similarity from which texts are alike, in hundredths; words of a shingle.
ALIKE, SHINGLE, SEED = 85, 3, 42
# MinHash values of a text; collisions from which a pair is checked, 37 of 64: P(fewer at 0.85) = 3.5e-8.
VALUES, MATCHES = 64, 37
# Slots that texts are looked up by before they are joined, as a power of 2.
SLOTS = 20
# Counters of tokens, as a power of 2; partners, signatures and shingles in one piece; shingles whose values are taken at once.
COUNTERS, PARTNERS, SIGNATURES, SHINGLES, CHUNK = 20, 512, 2_048, 1 << 20, 256

_draw = np.random.default_rng(SEED)
FLIPS = _draw.integers(0, 1 << 63, (VALUES, 1), np.uint64) << np.uint64(1)
ODD = _draw.integers(0, 1 << 63, (VALUES, 1), np.uint64) << np.uint64(1) | np.uint64(1)
COORDINATE = _draw.integers(0, 1 << 63, VALUES, np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, sorted; none for a text without words."""
    found = list(shingle_hashes(text, width, SEED))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate."""
    least = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[at : at + CHUNK] ^ FLIPS) * ODD).min(axis=1), out=least)
    return least


def tokens(signatures: np.ndarray) -> np.ndarray:
    """One number for each coordinate and its value, of signatures row by row."""
    mixed = (signatures ^ (signatures >> np.uint64(29)) ^ COORDINATE) * COORDINATE
    return mixed ^ (mixed >> np.uint64(32))


def prefixes(signatures: np.ndarray, levels: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` tokens of each signature, common ones last."""
    all_ = tokens(signatures)
    level = levels[(all_ >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    order = np.lexsort((all_, level), axis=-1)
    return np.take_along_axis(all_, order[:, :length], axis=1).view(np.int64)


def marks(values: np.ndarray) -> bytes:
    """A signature for counting collisions: 16 bits a value, where one more in 65,536 costs a check."""
    return (values & np.uint64(0xFFFF)).astype("<u2").tobytes()


def alike(shared: np.ndarray | int, size: np.ndarray | int, other: np.ndarray | int, limit: int = ALIKE):
    return 100 * shared >= limit * (size + other - shared)


def forest(sets: list[np.ndarray], labels: np.ndarray, split: int | None, limit: int) -> list[tuple[int, int]]:
    """Positions of alike sets, one pair for each two components joined; ``labels`` tells those known already.

    With ``split`` only pairs across that position are looked at.
    """
    labels, edges = labels.copy(), []
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    names, places = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(names), np.int64)
    for i in range(len(sets) - 1 if split is None else split):
        first = i + 1 if split is None else split
        near = (100 * np.minimum(sizes[first:], sizes[i]) >= limit * np.maximum(sizes[first:], sizes[i])) & (labels[first:] != labels[i])
        if not near.any():
            continue
        own = places[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        shared = np.add.reduceat(marked[places[starts[first] :]], starts[first:] - starts[first])
        marked[own] = 0
        for j in (np.nonzero(near & alike(shared, sizes[i], sizes[first:], limit))[0] + first).tolist():
            if labels[j] != labels[i]:
                edges.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal values in the first ``keys`` columns, from sorted batches; a group is held whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.nonzero(new)[0] + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _in_pairs(pairs: DataFrame, data: DataFrame, kind: str, good: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The ``pairs (a, b)`` for which ``good`` holds of their ``data (node, data)``.

    A node's partners are dealt out in chunks, each with one copy of its data, so a node of many partners is many small groups.
    """
    partners = pairs.groupBy("a").agg(F.count("*").alias("n"))
    own = partners.join(data, partners["a"] == data["node"]).select("a", "n", "data")
    own = own.selectExpr("a", f"explode(sequence(0, int(ceil(n / {PARTNERS})) - 1)) AS chunk", "CAST(NULL AS binary) AS b", "data")
    dealt = spread_join(pairs, partners, "a", "n").withColumn("chunk", F.expr(f"int(pmod(xxhash64(b), int(ceil(n / {PARTNERS}))))"))
    theirs = dealt.join(data.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, np.zeros(0, kind)
        for batch in batches:
            a, chunk, b, data = (batch.column(i) for i in range(4))
            kept = []
            for i in range(batch.num_rows):
                values = np.frombuffer(data[i].as_buffer(), kind)
                if not b[i].is_valid:
                    key, one = (a[i].as_py(), chunk[i].as_py()), values.copy()
                elif key == (a[i].as_py(), chunk[i].as_py()) and good(one, values):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    rows = own.unionByName(theirs).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, "a binary, b binary")


def _in_blocks(lists: DataFrame, compare: Callable[[pa.Table, int | None], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """``compare`` of every two blocks of each list of ``lists (token, blocks, ...)``: the rows of both, and where the second begins.

    Rows are dealt to the list's blocks by hash.
    """
    others = [c for c in lists.columns if c not in ("token", "blocks")]
    rows = lists.withColumn("own", F.expr("int(pmod(xxhash64(node), blocks))"))
    rows = rows.withColumn("mate", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("token", F.least("own", "mate").alias("p"), F.greatest("own", "mate").alias("q"), (F.col("own") > F.col("mate")).alias("second"), *others)
    rows = rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "second", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            same = group.column(1)[0] == group.column(2)[0]
            ahead = group.num_rows - int(np.count_nonzero(group.column(3).to_numpy()))
            if (group.num_rows > 1) if same else 0 < ahead < group.num_rows:
                yield from compare(group, None if same else ahead)

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def token_levels(nodes: DataFrame) -> np.ndarray:
    """The logarithm of each counter's count over all tokens of ``nodes (signature)``: at most 2^20 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                found = tokens(_matrix(batch.column(0), np.uint64)) >> np.uint64(64 - COUNTERS)
                total += np.bincount(found.ravel().astype(np.int64), minlength=1 << COUNTERS)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["counter", "n"])

    counted = nodes.select("signature").mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    levels = np.zeros(1 << COUNTERS, np.int8)
    found = counted.selectExpr("counter", "tinyint(floor(log2(n))) AS level").toArrow()
    levels[found["counter"].to_numpy()] = found["level"].to_numpy()
    return levels


def _sets(wanted: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``node, data``: the shingles of the texts ``wanted (node, first)``, from ``rows (doc_id, node, text)``.

    Texts are looked up by slot first, in a table of 2^20 at most, so that few of the others are shuffled.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, found, held = None, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["node", "data"])

        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                node = node.as_py()
                # Rows that repeat a document lie together behind the merge join.
                if node != last:
                    nodes.append(node)
                    found.append(shingle_set(text.as_py(), width).tobytes())
                    held += len(found[-1])
                last = node
                if held > 4 << 20:
                    yield out()
                    nodes, found, held = [], [], 0
        if nodes:
            yield out()

    slot = f"int(pmod(xxhash64(node, {{}}), {1 << SLOTS})) AS slot"
    slots = wanted.selectExpr(slot.format("first")).distinct()
    rows = rows.selectExpr("*", slot.format("doc_id")).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    met = rows.alias("r").join(wanted.alias("w").hint("merge"), F.expr("r.node = w.node AND r.doc_id <=> w.first"), "left_semi")
    return met.select("node", "text").mapInArrow(hashed, "node binary, data binary")


def links(
    nodes: DataFrame, rows: DataFrame, width: int, limit: int, matches: int, shingles: int, met: DataFrame | None = None
) -> DataFrame:
    """``a, b``: alike pairs that join every component of ``nodes (node, first, size, signature, marks)``.

    The texts are in ``rows (doc_id, node, text)`` under the doc_id ``first``. ``met (a, b)`` are pairs of another search,
    which are checked as well.
    """
    spark, length = nodes.sparkSession, VALUES - matches + 1
    levels = spark.sparkContext.broadcast(token_levels(nodes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                found = prefixes(_matrix(some.column(1), np.uint64), levels.value, length)
                places = pa.array(np.repeat(np.arange(some.num_rows), length))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), some.column(0).take(places)], ["token", "node"])

    posts = written(nodes.select("node", "signature").mapInArrow(post, "token bigint, node binary"), "postings")
    heads = posts.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = written(spread_join(posts, written(heads, "heads"), "token", "n"), "lists")

    stars = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    enough = lambda one, two: np.count_nonzero(one == two) >= matches
    signatures = nodes.select("node", F.col("marks").alias("data"))
    stars = written(_in_pairs(written(stars, "meetings"), signatures, "<u2", enough), "collisions")
    if met is not None:
        stars = written(stars.union(met.select("a", "b")).distinct(), "candidates")

    ends = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_sets(nodes.join(ends, "node", "left_semi").select("node", "first"), rows, width), "shingles")

    def same(one: np.ndarray, two: np.ndarray) -> bool:
        return bool(alike(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), limit))

    stars = written(_in_pairs(stars, sets, "<u8", same), "stars")

    # Lists of two have been compared whole; so have those that are one component.
    labels = components(stars)
    named = members.where("n > 2").join(labels, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("label"))
    named = written(named, "labels")
    several = named.groupBy("token", "n").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    several = written(several.selectExpr("token", f"int(ceil(n / {SIGNATURES})) AS blocks", "n AS copies"), "mixed-lists")
    mixed = spread_join(named.drop("n"), several, "token", "copies").select("token", "blocks", "node", "label")
    mixed = mixed.join(nodes.select("node", "size", "signature"), "node")

    def probe(group: pa.Table, split: int | None) -> list[pa.RecordBatch]:
        token, signed = group.column("token")[0].as_py(), _matrix(group.column("signature"), np.uint64)
        sizes, labels = group.column("size").to_numpy(), group.column("label").to_numpy(zero_copy_only=False)
        labels = np.unique(labels, return_inverse=True)[1]
        prefix = prefixes(signed, levels.value, length)
        needed = np.zeros(group.num_rows, bool)
        for i in range(group.num_rows - 1 if split is None else split):
            first = i + 1 if split is None else split
            fits = 100 * np.minimum(sizes[first:], sizes[i]) >= limit * np.maximum(sizes[first:], sizes[i])
            near = np.nonzero(fits & (labels[first:] != labels[i]))[0] + first
            if len(near):
                near = near[np.count_nonzero(signed[near] == signed[i], axis=1) >= matches]
            if len(near):
                # A pair is this list's if no smaller token is in both prefixes.
                earlier = prefix[i][prefix[i] < token]
                near = near[~np.isin(prefix[near], earlier).any(axis=1)]
            if len(near):
                needed[i] = True
                needed[near] = True
        columns = ["token", "node", "label", "size"]
        return group.filter(pa.array(needed)).select(columns).combine_chunks().to_batches()

    shape = "token bigint, node binary, label binary, size bigint"
    needed = written(_in_blocks(mixed, probe, shape).distinct(), "partners")
    counts = needed.groupBy("token").agg(F.sum("size").alias("total"), F.count("*").alias("copies"))
    counts = written(counts.selectExpr("token", f"int(ceil(total / {shingles})) AS blocks", "copies"), "partner-lists")

    def check(group: pa.Table, split: int | None) -> list[pa.RecordBatch]:
        nodes, labels = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label"))
        some = [np.frombuffer(s, np.uint64) for s in group.column("data").to_pylist()]
        edges = forest(some, np.unique(labels, return_inverse=True)[1], split, limit)
        return [pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])]

    more = needed.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    more = written(_sets(nodes.join(more, "node", "left_semi").select("node", "first"), rows, width), "more-shingles")
    sets = sets.unionByName(more)
    checked = spread_join(needed, counts, "token", "copies").join(sets, "node").select("token", "blocks", "node", "label", "data")
    return stars.unionByName(_in_blocks(checked, check, "a binary, b binary"))


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE,
    limit: int = ALIKE,
    matches: int = MATCHES,
    empty_alike: bool = False,
    shingles: int | None = None,
    search: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest doc_id reached over texts whose sets of ``width``-word shingles have a similarity of
    ``limit`` hundredths or more. A text of fewer words is one shingle; a NULL text and one without words are empty and
    linked with nothing. Rows of equal text are linked, whatever their doc_id; rows that repeat a doc_id with other texts are apart. A row
    without doc_id names no component, so its component_id is NULL where the component has no other. Texts of any
    length are read whole, in pieces. An empty table gives no rows. Other columns are not read, whatever their names.

    ``matches`` goes with ``limit``: a pair at the limit agrees in ``limit`` of a hundred coordinates on average. With
    ``empty_alike`` texts without words are one component instead. ``shingles`` are compared in one piece. Another ``search``
    gives pairs ``(a, b)`` of texts from ``nodes (node)`` and ``rows (node, text)``, which are checked besides those found here.
    """
    if not 0 < matches <= VALUES:
        raise ValueError(f"matches are 1 to {VALUES}")
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, width, limit, matches, empty_alike, shingles, search)


def _near_duplicates(docs, width, limit, matches, empty_alike, shingles, search) -> DataFrame:

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(2):
                # One set at a time: a batch of them is many times a batch of signatures.
                hashes = shingle_set(text.as_py(), width)
                sizes.append(len(hashes))
                found.append(signature(hashes))
            signed = [pa.array([f.tobytes() for f in found], pa.binary()), pa.array([marks(f) for f in found], pa.binary())]
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), *signed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "signature", "marks"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")
    signed = written(rows.mapInArrow(sign, "doc_id bigint, node binary, size bigint, signature binary, marks binary"), "signatures")
    words = signed.where("size > 0").groupBy("node")
    one = [F.first(c).alias(c) for c in ("size", "signature", "marks")]
    nodes = words.agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *one)
    nodes = written(nodes, "nodes")
    met = None if search is None else search(nodes.select("node"), rows.select("node", "text"))
    linked = components(written(links(nodes, rows, width, limit, matches, shingles or SHINGLES, met), "alike"))
    linked = written(linked.join(nodes.select("node", "first"), "node"), "linked")
    roots = linked.groupBy("root").agg(F.min("first").alias("reached"), F.count("*").alias("members"))
    reached = spread_join(linked.select("node", "root"), written(roots, "roots"), "root", "members").select("node", "reached")
    named = nodes.join(reached, "node", "left").select("node", "copies", F.coalesce("reached", "first").alias("component_id"))
    named = written(named, "components")
    known = spread_join(signed.where("size > 0").select("doc_id", "size", "node"), named, "node", "copies")
    empty = signed.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    if empty_alike:
        least = empty.agg(F.min("doc_id")).first()[0]
        empty = empty.withColumn("component_id", F.lit(least).cast("bigint"))
    found = known.select("doc_id", "size", "component_id").unionByName(empty)
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")
