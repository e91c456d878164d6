"""Many pairs of instances without a copy of a row for each pair.

Instances are numbered. Rows are counted per key and instance first, whatever the pairs; a key then has the set of instances
that hold it, 64 to a word, and each holder's partners are held against it word by word. Only pairs that differ
are written out, so one database against ten thousand others costs the findings and not ten thousand
copies of its rows. A key's set is bounded by the instances compared.

Rows are dealt by key once and sorted; keys that all agree in are left by a window over them, before any set is made.

``edges (node, other, side, pair_id)`` are the pairs from both ends: instance ``node`` is on ``side``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogdiff.functions import all_present

WORD = "node DIV 64"
BIT = "bit_or(shiftleft(1L, int(node % 64)))"
# Words of a set that are columns of a window; longer sets are collected as maps.
WORDS = 8


def _word_of(node: str, word: int) -> str:
    return f"bit_or(IF({node} DIV 64 = {word}, shiftleft(1L, int({node} % 64)), 0L))"


def _hinted(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def _partners(edges: DataFrame) -> DataFrame:
    """The partners of each instance as words."""
    words = edges.groupBy("node", F.expr("other DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(other % 64)))").alias("bits"))
    return words.groupBy("node").agg(F.collect_list(F.struct("word", "bits")).alias("partners"))


def _others(members: DataFrame, edges: DataFrame, small: bool, wanted: str, *kept: str) -> DataFrame:
    """Each member with every partner that is in the set ``wanted``, an expression for the word ``p.word``."""
    met = members.join(_hinted(_partners(edges), small), "node")
    words = f"filter(transform(partners, p -> struct(p.word AS word, p.bits & ({wanted}) AS bits)), p -> p.bits <> 0)"
    met = met.selectExpr(*kept, "node", f"inline({words})")
    met = met.selectExpr(*kept, "node", "word", "explode(filter(sequence(0, 63), b -> shiftright(bits, b) & 1 = 1)) AS bit")
    return met.selectExpr(*kept, "node", "int(word * 64 + bit) AS other")


def _set(name: str) -> str:
    return f"coalesce(try_element_at({name}, p.word), 0L)"


def counted_by(rows: DataFrame, keys: Sequence[str], extra: Column | None = None) -> DataFrame:
    """``*keys, node, _n``: rows per key and instance; ``extra`` is collected as a set, under the name ``_extra``."""
    more = [] if extra is None else [F.collect_set(extra).alias("_extra")]
    return rows.groupBy(*keys, "node").agg(F.count("*").alias("_n"), *more)


def lacking(
    counted: DataFrame, keys: Sequence[str], edges: DataFrame, small: bool, instances: int | None, whole: Sequence[str] = ()
) -> DataFrame:
    """``pair_id, *keys, _n1, _n2``: keys of ``counted (*keys, node, _n)`` that one instance of a pair lacks.

    A key with a NULL in ``whole`` (all of ``keys`` unless given) matches nothing, so every pair of a holder lacks
    it on both sides. Sets in ``_extra`` are those of the pair's instances together.
    """
    names = ["_extra"] if "_extra" in counted.columns else []
    whole = whole or keys
    dealt = counted.where(all_present(whole)).repartition(*keys)
    if instances is not None and instances <= 64 * WORDS:
        width = -(-instances // 64)
        of_key = Window.partitionBy(*keys)
        held = [F.expr(_word_of("node", w)).over(of_key).alias(f"_w{w}") for w in range(width)]
        some = " + ".join(f"bit_count(_w{w})" for w in range(width))
        # Holders all of whose partners hold the key too go before their sets are walked through.
        wanted = edges.groupBy("node").agg(*(F.expr(_word_of("other", w)).alias(f"_p{w}") for w in range(width)))
        lacked = " | ".join(f"(_p{w} & ~_w{w})" for w in range(width))
        holders = ", ".join(f"{w}, _w{w}" for w in range(width))
        members = dealt.select("*", *held).where(f"{some} < {instances}").join(_hinted(wanted, small), "node").where(f"({lacked}) <> 0")
        members = members.selectExpr(*keys, f"map({holders}) AS holders", "node", "_n", *names)
    else:
        words = dealt.groupBy(*keys, F.expr(WORD).alias("word"))
        words = words.agg(F.expr(BIT).alias("bits"), F.collect_list(F.struct("node", "_n", *names)).alias("held"))
        sets = words.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("holders"), F.flatten(F.collect_list("held")).alias("held")
        )
        if instances is not None:
            sets = sets.where(F.size("held") < instances)
        members = sets.select(*keys, "holders", F.inline("held"))
    found = _others(members, edges, small, f"~{_set('holders')}", *keys, "_n", *names)
    found = found.join(_hinted(edges, small), ["node", "other"])
    found = found.selectExpr("pair_id", *keys, "IF(side = 1, _n, 0L) AS _n1", "IF(side = 2, _n, 0L) AS _n2", *names)
    both = F.array_distinct(F.flatten(F.collect_list("_extra"))).alias("_extra") if names else None
    loose = counted.where(~all_present(whole)).join(_hinted(edges, small), "node")
    loose = loose.groupBy("pair_id", *keys).agg(F.lit(0).cast("bigint").alias("_n1"), F.lit(0).cast("bigint").alias("_n2"), *([both] if names else []))
    return found.unionByName(loose)


def totals(counted: DataFrame, keys: Sequence[str], edges: DataFrame, small: bool) -> DataFrame:
    """``pair_id, *keys, count_1, count_2``: every key of a pair, of ``counted (*keys, node, _n)``."""
    counted = counted.join(_hinted(edges, small), "node")
    return counted.groupBy("pair_id", *keys).agg(
        F.expr("sum(IF(side = 1, _n, 0L)) AS count_1"), F.expr("sum(IF(side = 2, _n, 0L)) AS count_2")
    )


def differing(
    counted: DataFrame, keys: Sequence[str], values: Sequence[str], unequal: str, edges: DataFrame, small: bool
) -> DataFrame:
    """``pair_id, *keys, l, r, _copies``: values of both sides of a pair for a key they both have, where ``unequal`` holds of them.

    ``counted (*keys, *values, node, _n)`` has one row for each value of a key in an instance; ``l`` and ``r`` are structs
    of the values. A key all instances agree in is left after one comparison, whatever the pairs.
    """
    value = F.struct(*values)
    dealt = counted.select(*keys, "node", "_n", value.alias("value")).repartition(*keys)
    # Keys of one value only are left here. What follows reads the same columns each time, so that rows are dealt by key once.
    of_key = Window.partitionBy(*keys)
    dealt = dealt.select("*", F.min("value").over(of_key).alias("low"), F.max("value").over(of_key).alias("high"))
    dealt = dealt.where("NOT (low <=> high)").drop("low", "high")
    # Who holds the key, and who holds several values of it.
    nodes = dealt.groupBy(*keys, "node").agg(F.expr("count_if(_n > 0) AS n"))
    several = "bit_or(IF(n > 1, shiftleft(1L, int(node % 64)), 0L))"
    words = nodes.groupBy(*keys, F.expr(WORD).alias("word")).agg(F.expr(BIT).alias("bits"), F.expr(several).alias("more"))
    changed = words.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("holders"),
        F.map_from_entries(F.collect_list(F.struct("word", "more"))).alias("several"),
    )
    same = dealt.groupBy(*keys, "value", F.expr(WORD).alias("word")).agg(F.expr(BIT).alias("bits"), F.collect_list(F.struct("node", "_n")).alias("held"))
    same = same.groupBy(*keys, "value").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("alike"), F.flatten(F.collect_list("held")).alias("held")
    )
    on = [same[k].eqNullSafe(changed[k]) for k in keys]
    members = same.join(changed, on).select(*[same[k] for k in keys], "value", "alike", "holders", "several", F.inline("held"))
    first = edges.where("side = 1")
    wanted = f"({_set('holders')} & ~{_set('alike')}) | {_set('several')}"
    met = _others(members, first, small, wanted, *keys, "value", "_n").alias("a")
    theirs = dealt.select(*keys, "node", F.col("_n").alias("_m"), F.col("value").alias("r")).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pairs = met.join(theirs, [*on, F.col("a.other") == F.col("b.node")])
    pairs = pairs.selectExpr(*[f"a.{k} AS {k}" for k in keys], "a.node AS node", "a.other AS other", "a.value AS l", "b.r AS r", "a._n * b._m AS _copies")
    return pairs.where(unequal).join(_hinted(first, small), ["node", "other"]).select("pair_id", *keys, "l", "r", "_copies")
