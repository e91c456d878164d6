"""Run sections: lazy result tables, one findings table, and a summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.functions import parse_owner_list, parse_owner_map, quoted, shown
from catalogdiff.operators.selection import InstancePairs, TwoInstances, pair_id, pick_instances, renamed
from catalogdiff.plans.custom import custom_section
from catalogdiff.plans.sections import MAPPED_SECTIONS, OF_OBJECTS, SECTIONS, Comparison, Section

MAP_COLUMNS = ("owner_1", "owner_2")


class Report:
    """Sections of one comparison. With named instances nothing runs until a result is used or written."""

    def __init__(
        self, comparison: Comparison, sections: Mapping[str, Section], custom: Mapping[str, str], ordered: bool
    ):
        self.comparison = comparison
        self.sections = dict(sections)
        self.custom = tuple(custom)
        self.results = {}
        shared = sum(s.build in OF_OBJECTS for s in sections.values()) > 1
        for title, s in sections.items():
            # Only sections of pairs have a pair to sort by first; an unsorted section stays so.
            group = comparison.sides.group if s.values else ()
            order = (*group, *s.order) if ordered and s.order else ()
            self.results[title] = s.build(replace(comparison, order=order, shared=shared))
        for title, text in custom.items():
            self.results[title] = custom_section(text, comparison)

    def __getitem__(self, title: str) -> DataFrame:
        return self.results[title]

    def findings(self) -> DataFrame:
        """Rows of all sections: ``pair_id, section, key, value_1, value_2``.

        Custom sections have columns of their own, all of which go into the key.
        """
        parts = [self._findings_of(title, s) for title, s in self.sections.items()]
        parts += [self._custom_findings(title) for title in self.custom]
        return reduce(DataFrame.unionByName, parts)

    def _findings_of(self, title: str, section: Section) -> DataFrame:
        rows, sides = self.results[title], self.comparison.sides
        rows = renamed(rows, {sides.label(side, v): f"{v}_{side}" for v in section.values for side in (1, 2)})
        names = [*(c for c in MAP_COLUMNS if c in rows.columns), *section.keys]
        key = F.create_map(*[part for n in names for part in (F.lit(n), F.col(n).cast("string"))])
        values = []
        for side in (1, 2):
            value = section.value(side)
            if value is None and section.values:
                value = shown({v: F.col(f"{v}_{side}") for v in section.values})
            values.append(F.lit(None).cast("string") if value is None else value.cast("string"))
        per_pair = sides.group and section.values
        pair = F.col("pair_id") if per_pair else F.lit(self.pair_id)
        return rows.select(
            pair.cast("string").alias("pair_id"),
            F.lit(title).alias("section"),
            key.alias("key"),
            values[0].alias("value_1"),
            values[1].alias("value_2"),
        )

    def _custom_findings(self, title: str) -> DataFrame:
        rows, none = self.results[title], F.lit(None).cast("string")
        many = bool(self.comparison.sides.group)
        pair = F.col("pair_id") if many else F.lit(self.pair_id)
        names = [n for n in rows.columns if not (many and n == "pair_id")]
        key = F.create_map(*[part for n in names for part in (F.lit(n), F.col(quoted(n)).cast("string"))])
        return rows.select(
            pair.cast("string").alias("pair_id"), F.lit(title).alias("section"),
            key.cast("map<string,string>").alias("key"), none.alias("value_1"), none.alias("value_2"),
        )

    @property
    def pair_id(self) -> str | None:
        """The id of the one pair compared; NULL for rows that belong to no pair."""
        sides = self.comparison.sides
        return pair_id(sides.first, sides.second) if isinstance(sides, TwoInstances) else None

    def summary(self, findings: DataFrame | None = None) -> DataFrame:
        """Findings per section and pair, sections without any included."""
        found = self.findings() if findings is None else findings
        counted = found.groupBy("pair_id", "section").agg(F.count("*").alias("_n"))
        listed = self._expected()
        match = counted["pair_id"].eqNullSafe(listed["pair_id"]) & (counted["section"] == listed["section"])
        return listed.join(counted, match, "left").select(
            listed["pair_id"], listed["section"], F.coalesce("_n", F.lit(0)).cast("bigint").alias("findings")
        )

    def _expected(self) -> DataFrame:
        """Every section of every pair: a constant list exploded per pair."""
        sides = self.comparison.sides
        spark = self.comparison.staging[next(iter(self.comparison.staging))].sparkSession
        titles = F.explode(F.array(*[F.lit(t) for t in (*self.sections, *self.custom)])).alias("section")
        if isinstance(sides, TwoInstances):
            return spark.range(1).select(F.lit(self.pair_id).alias("pair_id"), titles)
        general = [t for t, s in self.sections.items() if not s.values]
        per_pair = [*(t for t, s in self.sections.items() if s.values), *self.custom]
        parts = []
        if general:
            none = F.lit(None).cast("string").alias("pair_id")
            parts.append(spark.range(1).select(none, F.explode(F.array(*map(F.lit, general))).alias("section")))
        if per_pair:
            titles = F.explode(F.array(*map(F.lit, per_pair))).alias("section")
            parts.append(sides.pairs.select(F.col("pair_id").cast("string"), titles))
        return reduce(DataFrame.unionByName, parts)


def compare(
    staging: Mapping[str, DataFrame],
    instances: tuple[str, str] | None = None,
    pairs: DataFrame | Sequence[tuple[str, str]] | None = None,
    sections: Sequence[str] | None = None,
    owners: Sequence[str] | str | None = None,
    owner_maps: Sequence[tuple[str, str]] | str | None = None,
    custom: Mapping[str, str] | None = None,
    universe: str = "staged",
    dedupe: bool = False,
    ordered: bool = False,
) -> Report:
    """Compare two staged instances, or every pair of ``pairs`` in one job.

    ``instances`` defaults to the first two staged ids. ``owners`` restricts the
    schemas compared, ``owner_maps`` compares schemas of different names
    instead, and picks the mapped sections; both may be text (``"A, B"``,
    ``"SOURCE/TARGET"``). A result that names an instance which is not staged fails when it is used. ``sections`` are titles; without it
    the default ones run. ``custom`` maps titles to SQL texts.
    """
    owners = parse_owner_list(owners) if isinstance(owners, str) else owners
    owner_maps = parse_owner_map(owner_maps) if isinstance(owner_maps, str) else owner_maps
    owner_maps = owner_maps and list(dict.fromkeys(map(tuple, owner_maps)))
    if instances is not None and pairs is not None:
        raise ValueError("give two instances or many pairs, not both")
    listed = staging["instances"]
    if pairs is not None:
        sides = InstancePairs.of(listed.sparkSession, pairs, listed)
    elif instances is not None:
        sides = TwoInstances(*instances, universe, listed)
    else:
        sides = TwoInstances(*pick_instances(listed), universe)
    registry = MAPPED_SECTIONS if owner_maps else SECTIONS
    titles = [t for t, s in registry.items() if s.default] if sections is None else list(sections)
    unknown = [t for t in titles if t not in registry]
    if unknown:
        raise ValueError(f"no such sections: {unknown}")
    chosen = Comparison(staging, sides, owners, owner_maps, dedupe)
    return Report(chosen, {t: registry[t] for t in titles}, custom or {}, ordered)


def write_findings(report: Report, path: str) -> DataFrame:
    """Write the findings by section, and next to them the summary; returns the summary.

    The summary is counted from the written findings, so sections run once.
    """
    findings = f"{path}/findings"
    report.findings().write.mode("overwrite").partitionBy("section").parquet(findings)
    spark = report.comparison.staging[next(iter(report.comparison.staging))].sparkSession
    schema = "pair_id string, key map<string,string>, value_1 string, value_2 string, section string"
    report.summary(spark.read.schema(schema).parquet(findings)).write.mode("overwrite").parquet(f"{path}/summary")
    return spark.read.parquet(f"{path}/summary")
