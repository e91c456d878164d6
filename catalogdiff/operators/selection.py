"""Which rows take part in a comparison, and on which side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogdiff.functions import listed, literal, parse_owner_list

# Above this many owners an IN list is replaced by a semi join.
MAX_IN_LIST = 1_000
# Size up to which a helper table is broadcast by hint: rows, and bytes of text.
# Beyond it no hint is given and Spark chooses by its own size checks.
MAX_HINTED_ROWS = 100_000
MAX_HINTED_BYTES = 8 * 1024 * 1024
# Ranges used to number instances without putting them all in one task.
RANK_RANGES = 200


def fits(rows: int, size: int) -> bool:
    """Whether a table of that many rows and bytes may be broadcast by hint."""
    return rows <= MAX_HINTED_ROWS and size <= MAX_HINTED_BYTES


def text_size(rows: Sequence[tuple]) -> int:
    """Bytes of text in rows."""
    return sum(len(value.encode()) for row in rows for value in row if isinstance(value, str))


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A helper table from values at hand, broadcast by hint if its size allows."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if fits(len(rows), text_size(rows)) else table


def instances(table: DataFrame) -> DataFrame:
    """The distinct instance ids of a staged table."""
    return table.select(F.col("pkey").alias("instance_id")).distinct()


def described(raw: Mapping[str, DataFrame]) -> DataFrame:
    """The distinct ``pkey`` of all raw tables of a fleet: a database without objects may have other facts."""
    some = [table.select("pkey").distinct() for table in raw.values() if "pkey" in table.columns]
    return reduce(DataFrame.union, some).distinct()


def pick_instances(table: DataFrame) -> tuple[str, str]:
    """The first two instance ids in order; the only values that reach the driver."""
    ids = table.select("pkey").where(F.col("pkey").isNotNull()).distinct().orderBy("pkey").limit(2).collect()
    if len(ids) < 2:
        raise ValueError("a comparison needs at least two staged instances")
    return ids[0]["pkey"], ids[1]["pkey"]


def known_instances(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Keep rows of instances listed in the ``instances`` table.

    The ids are as many as instances, so Spark's own size check broadcasts them in most cases;
    no job measures them while a comparison is built.
    """
    ids = table.select("pkey").where(F.col("pkey").isNotNull()).distinct()
    return rows.join(ids, "pkey", "left_semi").select(*rows.columns)


def instance_rank(table: DataFrame) -> DataFrame:
    """Number the distinct instance ids from 1 in id order.

    One window over all ids would be one task. Ids are cut into ranges at a
    bounded hash-chosen sample, numbered within their range, and shifted by the
    sizes of the ranges before (at most RANK_RANGES rows, hence the broadcast).
    """
    ids = instances(table)
    sample = ids.where(F.col("instance_id").isNotNull()).orderBy(F.xxhash64("instance_id"), "instance_id")
    cuts = sorted(r["instance_id"] for r in sample.limit(RANK_RANGES - 1).collect())
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<string>")
    # NULL sorts first, as in Spark's own ORDER BY.
    range_no = F.coalesce(F.size(F.filter(bounds, lambda cut: cut <= F.col("instance_id"))), F.lit(0))
    ids = ids.withColumn("_range", F.when(F.col("instance_id").isNull(), -1).otherwise(range_no))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ids.groupBy("_range").agg(F.count("*").alias("_n"))
    shift = shift.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("instance_id"))
    return (
        ids.withColumn("_inside", inside)
        .join(F.broadcast(shift), "_range")
        .select("instance_id", (F.col("_shift") + F.col("_inside")).cast("bigint").alias("rn"))
    )


def filter_owners(rows: DataFrame, owners: Sequence[str] | str | None) -> DataFrame:
    """Keep rows of the given owners (a list, or text with commas), compared as typed; None keeps all."""
    owners = parse_owner_list(owners) if isinstance(owners, str) else owners
    if owners is None:
        return rows
    names = list(dict.fromkeys(owners))
    if len(names) <= MAX_IN_LIST:
        return rows.where(f"owner IN ({listed(names)})" if names else "false")
    wanted = local_table(rows.sparkSession, [(n,) for n in names], "owner string")
    # A join on a shared name moves it to the front; columns stay as they are for a short list.
    return rows.join(wanted, "owner", "left_semi").select(*rows.columns)


def renamed(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed by place: names may differ in case only, which tells them apart nowhere else."""
    return rows.toDF(*[names.get(c, c) for c in rows.columns])


@dataclass(frozen=True)
class TwoInstances:
    """A comparison of two instances; ``universe`` says whose keys are looked at.

    ``"staged"`` takes the keys of every staged instance, so a key only a third
    one holds shows as missing on both sides. ``"pair"`` reads the partitions of
    the two instances only.
    """

    first: str
    second: str
    universe: str = "staged"
    # The table of staged instances; a query then fails if one of the two is not in it.
    listed: DataFrame | None = field(default=None, compare=False)

    group: tuple[str, ...] = ()

    def __post_init__(self):
        if self.first == self.second:
            raise ValueError("the two instances must differ")
        if self.universe not in ("staged", "pair"):
            raise ValueError("universe is 'staged' or 'pair'")

    @property
    def ids(self) -> tuple[str, str]:
        return self.first, self.second

    def tag(self, rows: DataFrame, own_only: bool = False) -> DataFrame:
        """Add ``side``: 1, 2, or 0 for an instance that only adds to the universe.

        ``own_only`` drops side 0 where it cannot change the result, so that
        the scan prunes to two partitions.
        """
        if own_only or self.universe == "pair":
            rows = rows.where(f"pkey IN ({listed((self.first, self.second))})")
        else:
            rows = rows.where("pkey IS NOT NULL")
        one, two = literal(self.first), literal(self.second)
        if self.listed is not None:
            # Part of the query: the few rows of the two ids are looked up when it runs.
            missing = ", ".join(f"IF(bool_or(pkey = {i}), NULL, {i})" for i in (one, two))
            both = f"CASE WHEN bool_or(pkey = {one}) AND bool_or(pkey = {two}) THEN true ELSE raise_error(concat('not staged: ', concat_ws(', ', {missing}))) END"
            rows = rows.where(self.listed.where(f"pkey IN ({one}, {two})").agg(F.expr(both).alias("there")).scalar())
        return rows.selectExpr("*", f"CASE pkey WHEN {one} THEN 1 WHEN {two} THEN 2 ELSE 0 END AS side")

    def label(self, side: int, what: str) -> str:
        return f"{self.first if side == 1 else self.second}_{what}"

    def labelled(self, rows: DataFrame, *values: str) -> DataFrame:
        """Columns ``<value>_1, <value>_2`` under the names of the instances."""
        return renamed(rows, {f"{v}_{side}": self.label(side, v) for v in values for side in (1, 2)})


def pair_id(first: str, second: str) -> str:
    """``first|second``; a bar inside an id is escaped, so that two pairs never have one name."""
    return "|".join(i.replace("\\", "\\\\").replace("|", "\\|") for i in (first, second))


@dataclass(frozen=True)
class InstancePairs:
    """Many comparisons in one job: ``pairs`` has ``pair_id, pkey_1, pkey_2``.

    A pair looks at its own keys only. A pair given twice is one pair; a pair of an instance with
    itself or with NULL, an id for two pairs, and with ``listed`` an instance that is not staged, fail.
    ``numbers (pkey, node)`` are the instances, ``edges (node, other, side, pair_id)`` the pairs from both ends.
    ``small`` ones are broadcast; otherwise joins are plain ones, and adaptive execution splits an instance that holds much of the
    table. ``known`` ids, where they are few, prune the scan.
    """

    pairs: DataFrame
    small: bool
    numbers: DataFrame
    edges: DataFrame
    count: int | None = None
    known: tuple[str, ...] | None = None
    listed: DataFrame | None = field(default=None, compare=False)

    group: tuple[str, ...] = ("pair_id",)

    @classmethod
    def of(
        cls, spark: SparkSession, pairs: DataFrame | Sequence[tuple[str, str]], listed: DataFrame | None = None
    ) -> InstancePairs:
        if not isinstance(pairs, DataFrame):
            if any(a is None or b is None or a == b for a, b in pairs):
                raise ValueError("the two instances of a pair must differ")
            rows = [(pair_id(a, b), a, b) for a, b in dict.fromkeys(map(tuple, pairs))]
            pairs = spark.createDataFrame(rows, "pair_id string, pkey_1 string, pkey_2 string")
            number = {i: n for n, i in enumerate(dict.fromkeys(i for _, *ends in rows for i in ends))}
            ends = [e for p, a, b in rows for e in ((number[a], number[b], 1, p), (number[b], number[a], 2, p))]
            numbers = spark.createDataFrame(list(number.items()), "pkey string, node int")
            edges = spark.createDataFrame(ends, "node int, other int, side int, pair_id string")
            known = tuple(number) if len(number) <= MAX_IN_LIST else None
            return cls(pairs, fits(len(rows), text_size(rows)), numbers, edges, len(number), known, listed)
        ends = "struct(pkey_1, pkey_2)"
        pairs = pairs.groupBy("pair_id").agg(F.expr(f"min({ends})").alias("low"), F.expr(f"max({ends})").alias("high"))
        fault = "raise_error('a pair_id names two pairs, or a pair whose instances do not differ')"
        one = f"CASE WHEN low <=> high AND low.pkey_1 <> low.pkey_2 THEN low ELSE {fault} END AS pair"
        pairs = pairs.selectExpr("pair_id", one).select("pair_id", "pair.pkey_1", "pair.pkey_2")
        # Measured no further than the bound.
        texts = "octet_length(concat_ws('', string(pair_id), pkey_1, pkey_2))"
        head = pairs.limit(MAX_HINTED_ROWS + 1).selectExpr("count(*)", f"coalesce(sum({texts}), 0L)").first()
        numbers = instance_rank(pairs.select(F.explode(F.array("pkey_1", "pkey_2")).alias("pkey")))
        numbers = numbers.selectExpr("instance_id AS pkey", "int(rn - 1) AS node")
        both = pairs.join(numbers.toDF("pkey_1", "node_1"), "pkey_1").join(numbers.toDF("pkey_2", "node_2"), "pkey_2")
        ends = "inline(array(struct(node_1 AS node, node_2 AS other, 1 AS side), struct(node_2 AS node, node_1 AS other, 2 AS side)))"
        return cls(pairs, fits(*head), numbers, both.selectExpr(ends, "pair_id"), listed=listed)

    @property
    def ids(self) -> tuple[str, ...] | None:
        return self.known

    def nodes(self, rows: DataFrame) -> DataFrame:
        """Rows of the instances compared, which ``node`` names instead of ``pkey``: as many as there are, whatever the pairs."""
        return self._numbered(rows).drop("pkey")

    def tag(self, rows: DataFrame, own_only: bool = False) -> DataFrame:
        """Rows with ``pair_id`` and ``side``, once for each pair of their instance: for texts that group by pair."""
        edges = F.broadcast(self.edges) if self.small else self.edges
        return self._numbered(rows).join(edges.drop("other"), "node").drop("node")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        if self.known is not None:
            rows = rows.where(f"pkey IN ({listed(self.known)})" if self.known else "false")
        if self.listed is not None:
            # Part of the query, and apart from its joins, whose filters would take such an id away before it fails.
            staged = self.listed.select("pkey").where("pkey IS NOT NULL").distinct()
            unknown = self.numbers.join(staged, "pkey", "left_anti")
            none = "CASE WHEN count(*) = 0 THEN true ELSE raise_error(concat('not staged: ', min(pkey))) END"
            rows = rows.where(unknown.agg(F.expr(none).alias("there")).scalar())
        return rows.join(F.broadcast(self.numbers) if self.small else self.numbers, "pkey")

    def label(self, side: int, what: str) -> str:
        return f"{what}_{side}"

    def labelled(self, rows: DataFrame, *values: str) -> DataFrame:
        """The rows as they are: columns of many pairs are named by side."""
        return rows


def map_columns(owner_maps: Sequence[tuple[str, str]]) -> list[str]:
    """Columns that tell several owner maps apart; a single map needs none."""
    return [] if len(owner_maps) == 1 else ["owner_1", "owner_2"]


def map_roles(rows: DataFrame, owner_maps: Sequence[tuple[str, str]]) -> DataFrame:
    """As ``map_owners`` for rows with a ``node`` and no side: a node's two sides are nodes of their own."""
    sided = rows.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2))))
    return map_owners(sided, owner_maps).withColumn("node", F.expr("2 * node + side - 1")).drop("side")


def edge_roles(edges: DataFrame) -> DataFrame:
    """Edges between the nodes of ``map_roles``."""
    return edges.selectExpr("2 * node + side - 1 AS node", "2 * other + 2 - side AS other", "side", "pair_id")


def map_owners(rows: DataFrame, owner_maps: Sequence[tuple[str, str]]) -> DataFrame:
    """Keep tagged rows whose owner is mapped for their side; add ``owner_1, owner_2``."""
    if len(owner_maps) == 1:
        one, two = map(literal, owner_maps[0])
        mine = rows.where(f"(side = 1 AND owner = {one}) OR (side = 2 AND owner = {two})")
        return mine.selectExpr("*", f"{one} AS owner_1", f"{two} AS owner_2")
    ends = [(side, pair[side - 1], *pair) for pair in dict.fromkeys(owner_maps) for side in (1, 2)]
    maps = local_table(rows.sparkSession, ends, "side int, owner string, owner_1 string, owner_2 string")
    return rows.join(maps, ["side", "owner"])
