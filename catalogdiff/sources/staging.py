"""Staged snapshots: parquet tables in versions, and a manifest that names the version of each instance.

A load writes its tables under a version of its own and then adds one small file to the manifest, which names the
instances it replaces and the tables it replaces of them. Readers resolve the manifest, so a table that is now empty
replaces the old one, a load that fails changes nothing, and no reader sees half of one.

    <path>/<table>/staged_version=<version>/staged_bucket=<bucket>/part-…
    <path>/_manifest/part-…

Rows are dealt to buckets by a hash of the instance id and sorted by it inside, so the files are bounded by buckets and
data, however many instances there are; a read of few instances prunes buckets by folder and the rest by statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogdiff.functions import listed, literal, quoted
from catalogdiff.operators.selection import MAX_HINTED_ROWS, MAX_IN_LIST, fits, local_table
from catalogdiff.operators.supplied import sourcecode_rollup
from catalogdiff.schemas import STAGED, conform
from catalogdiff.sources.extracts import extract_tables, read_extracts

# Folders of a version; a load of one instance has one.
BUCKETS = 64
VERSION, BUCKET = "staged_version", "staged_bucket"
MANIFEST = "_manifest"
# ``at`` orders loads by when they were done. A NULL pkey stands for a table without instances; NULL tables for all there are.
ENTRY = T.StructType([
    T.StructField("at", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("pkey", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StringType())),
])


def _bucket(pkey: str) -> str:
    return f"int(pmod(hash({pkey}), {BUCKETS}))"


@dataclass(frozen=True)
class Manifest:
    """Which version of a table holds each instance: ``entries (at, version, pkey, tables)``, ``known`` where they are few."""

    entries: DataFrame
    known: tuple[tuple[str, str, str | None, tuple[str, ...] | None], ...] | None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest:
        """The manifest as it is now: later loads are not seen through it."""
        try:
            entries = spark.read.schema(ENTRY).parquet(f"{path}/{MANIFEST}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            entries = spark.createDataFrame([], ENTRY)
        sizes = "octet_length(concat_ws('', at, version, pkey, array_join(tables, '')))"
        head = entries.limit(MAX_HINTED_ROWS + 1).selectExpr("*", f"{sizes} AS size").collect()
        if not fits(len(head), sum(row["size"] for row in head)):
            return cls(entries, None)
        return cls(entries, tuple((r["at"], r["version"], r["pkey"], None if r["tables"] is None else tuple(r["tables"])) for r in head))

    def current(self, table: str) -> dict[str | None, str] | None:
        """The version of each instance of a table, where the manifest is small."""
        if self.known is None:
            return None
        found: dict[str | None, tuple[str, str]] = {}
        for at, version, pkey, tables in self.known:
            if pkey is not None if tables is None else table in tables:
                found[pkey] = max((at, version), found.get(pkey, ("", "")))
        return {pkey: version for pkey, (_, version) in found.items()}

    def resolve(self, rows: DataFrame, table: str, ids: Sequence[str] | None = None) -> DataFrame:
        """Rows of the current versions, of the instances ``ids`` only where given.

        ``rows`` have their version, bucket and instance; a table without instances is not for here.
        """
        if ids is not None:
            buckets = ", ".join(_bucket(literal(i)) for i in ids)
            rows = rows.where(f"pkey IN ({listed(ids)}) AND {BUCKET} IN ({buckets})" if ids else "false")
        current = self.current(table)
        if current is None:
            return self._joined(rows, table)
        versions = {pkey: v for pkey, v in current.items() if pkey is not None and (ids is None or pkey in ids)}
        used = sorted(set(versions.values()))
        if not used:
            return rows.where("false")
        # Instances that a used version holds and a later load has replaced.
        old = {(v, p) for _, v, p, t in self.known if v in used and p in versions and versions[p] != v and (t is None or table in t)}
        if len(used) > MAX_IN_LIST:
            kept = local_table(rows.sparkSession, [(p, v) for p, v in versions.items()], f"pkey string, {VERSION} string")
            return rows.join(kept, ["pkey", VERSION], "left_semi").select(*rows.columns)
        rows = rows.where(f"{VERSION} IN ({listed(used)})")
        if len(old) <= MAX_IN_LIST:
            stale = [f"({VERSION} = {literal(v)} AND pkey = {literal(p)})" for v, p in sorted(old)]
            return rows.where(f"NOT ({' OR '.join(stale)})") if stale else rows
        gone = local_table(rows.sparkSession, sorted(old), f"{VERSION} string, pkey string")
        return rows.join(gone, [VERSION, "pkey"], "left_anti").select(*rows.columns)

    def _joined(self, rows: DataFrame, table: str) -> DataFrame:
        mine = self.entries.where(F.col("pkey").isNotNull() & (F.col("tables").isNull() | F.array_contains("tables", table)))
        latest = mine.groupBy("pkey").agg(F.max_by("version", F.struct("at", "version")).alias(VERSION))
        return rows.join(latest, ["pkey", VERSION], "left_semi").select(*rows.columns)


class Staging(Mapping[str, DataFrame]):
    """Staged tables by name. ``sourcecode`` is derived unless it is staged itself."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables = dict(tables)

    @classmethod
    def open(cls, spark: SparkSession, path: str, tables: list[str] | None = None) -> Staging:
        """Tables of a staging folder as of now, read lazily and only when a section asks for them.

        Without ``tables`` those of the user's own are found as well, under the names they were staged by.
        """
        return _Folder(spark, path, tables, Manifest.read(spark, path))

    def of(self, ids: Sequence[str]) -> Staging:
        """The staging for reads of the given instances only, which a folder can prune; filters stay with the reader."""
        return self

    def __getitem__(self, name: str) -> DataFrame:
        if name == "sourcecode" and name not in self._tables:
            return sourcecode_rollup(self["sourcecodedetailed"])
        if name not in self._tables:
            raise KeyError(f"table {name!r} is not staged")
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)


class _Folder(Staging):
    def __init__(self, spark: SparkSession, path: str, tables: list[str] | None, manifest: Manifest, ids: Sequence[str] | None = None):
        super().__init__({})
        self._spark, self._path, self._names, self._any = spark, path, tables or list(STAGED), tables is None
        self._manifest, self._ids, self._given = manifest, ids, tables

    def of(self, ids: Sequence[str]) -> Staging:
        if len(ids) > MAX_IN_LIST:
            return self
        return _Folder(self._spark, self._path, self._given, self._manifest, tuple(ids))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables and (self._any or name in self._names):
            try:
                self._tables[name] = read_staged(self._spark, self._path, name, self._manifest, self._ids)
            except AnalysisException as error:
                # The rollup can be had without being staged; a name that is not known is a missing key.
                if error.getCondition() != "PATH_NOT_FOUND" or name in STAGED and name != "sourcecode":
                    raise
        return super().__getitem__(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def read_staged(
    spark: SparkSession, path: str, table: str, manifest: Manifest | None = None, ids: Sequence[str] | None = None
) -> DataFrame:
    """One staged table, of the instances ``ids`` only where given. The schema is given, so an id such as ``007`` stays text."""
    manifest = manifest or Manifest.read(spark, path)
    folder, schema = f"{path}/{table}", STAGED.get(table)
    if schema is None:
        # A table of the user's own: text columns, which loads need not agree in, whatever its instance ids look like.
        found = [c for c in spark.read.option("mergeSchema", True).parquet(folder).columns if c not in (VERSION, BUCKET)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in found])
    places = T.StructType([T.StructField(VERSION, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    rows = spark.read.schema(T.StructType([*schema.fields, *places.fields])).parquet(folder)
    if "pkey" not in map(str.lower, schema.names):
        current = manifest.current(table)
        if current is None:
            mine = manifest.entries.where(F.col("pkey").isNull() & F.array_contains("tables", table))
            rows = rows.join(mine.agg(F.max_by("version", F.struct("at", "version")).alias(VERSION)), VERSION, "left_semi")
        else:
            rows = rows.where(F.col(VERSION) == current[None]) if None in current else rows.where("false")
        return rows.select(*map(quoted, schema.names))
    return manifest.resolve(rows, table, ids).select(*map(quoted, schema.names))


def _write(rows: DataFrame, path: str, table: str, version: str) -> bool:
    """Write rows of a load; tells whether the table has instances."""
    if table in STAGED:
        rows = conform(rows, table)
    folder = f"{path}/{table}/{VERSION}={version}"
    if "pkey" not in map(str.lower, rows.columns):
        rows.withColumn(BUCKET, F.lit(0)).write.partitionBy(BUCKET).parquet(folder)
        return False
    missing = f"raise_error({literal(f'a row of {table} has no pkey')})"
    rows = rows.withColumn("pkey", F.expr(f"CASE WHEN pkey <> '' THEN pkey ELSE {missing} END"))
    # Gathered by bucket, so that one is a few files rather than one per task; a large one is split at run time.
    rows = rows.withColumn(BUCKET, F.expr(_bucket("pkey"))).hint("rebalance", BUCKET)
    rows.sortWithinPartitions(BUCKET, "pkey").write.partitionBy(BUCKET).parquet(folder)
    return True


def _now() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S.%f}"


def stage(
    tables: Mapping[str, DataFrame], path: str, instances: Sequence[str] = (), whole: bool = False, at: str | None = None
) -> str | None:
    """Load tables: each instance in any of them, or named in ``instances``, has the given tables replaced, all at once.

    A given table without rows of an instance leaves it without any. With ``whole`` the instance's other tables, which are not
    given, are emptied as well. Other instances stay as they are. A row without an instance
    id fails the load. A table of the user's own keeps its columns; one without ``pkey`` is replaced as a whole. A load
    that fails changes nothing, and one that is run again is a new load. Of loads of one instance the one done
    last counts. ``at`` stands for that time instead. Returns the load's version.
    """
    if not tables:
        return None
    spark = next(iter(tables.values())).sparkSession
    version = f"{_now()}-{uuid.uuid4().hex[:8]}"
    keyed = {name: _write(rows, path, name, version) for name, rows in tables.items()}
    ids = spark.createDataFrame([(i,) for i in instances], "pkey string")
    for name, has_instances in keyed.items():
        if has_instances:
            # From what was written, of which only the one column is read.
            rows = spark.read.schema("pkey string").parquet(f"{path}/{name}/{VERSION}={version}")
            ids = ids.unionByName(rows.select("pkey").distinct())
    own = [name for name, has_instances in keyed.items() if not has_instances]
    replaced = "CAST(NULL AS array<string>)" if whole else f"array({listed([n for n in keyed if keyed[n]])})"
    at = at or _now()
    entries = ids.distinct().selectExpr(f"{literal(at)} AS at", f"{literal(version)} AS version", "pkey", f"CAST({replaced} AS array<string>) AS tables")
    if own:
        entries = entries.unionByName(spark.createDataFrame([(at, version, None, own)], ENTRY))
    # One file, which appears as a whole: the load is done when it is there.
    entries.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return version


def write_staged(rows: DataFrame, path: str, table: str, instances: Sequence[str] = ()) -> None:
    """Load one table: the instances that ``rows`` holds, or ``instances`` names, have it replaced."""
    stage({table: rows}, path, instances)


def compact(spark: SparkSession, path: str) -> str | None:
    """Load all current rows again as one version, so that many loads of few instances become few files.

    A load that is done meanwhile goes before it, whenever it began. What it was read from stays for readers that have it
    open; ``superseded`` tells what nobody will read again.
    """
    manifest = Manifest.read(spark, path)
    last = manifest.entries.agg(F.max("at")).first()[0]
    names = [row["name"] for row in manifest.entries.select(F.explode("tables").alias("name")).distinct().collect()]
    tables = {}
    for name in sorted({*STAGED, *names}):
        try:
            tables[name] = read_staged(spark, path, name, manifest)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return stage(tables, path, at=f"{last}+")


def superseded(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``version`` of the loads of a table that are no instance's current one, which may be deleted once no reader has them open."""
    entries = Manifest.read(spark, path).entries
    mine = entries.where(F.col("tables").isNull() | F.array_contains("tables", table))
    latest = mine.groupBy("pkey").agg(F.max_by("version", F.struct("at", "version")).alias("version")).select("version").distinct()
    return mine.select("version").distinct().join(latest, "version", "left_anti")


def import_extracts(
    spark: SparkSession, folder: str, path: str, tables: list[str] | None = None, splittable: bool = False
) -> list[str]:
    """Load the extracts of a folder into staging as one load; returns the tables loaded.

    Without ``tables``, every table that has an extract is loaded, and the instances in them are replaced whole: a table they
    have no extract of is empty for them. One that is not known is a
    table of the user's own: its header names its columns, which are text, and custom
    sections read it by its name. A record that does not fit its table fails the job.
    ``splittable`` reads big files in pieces, where no record goes over several lines.
    """
    own = sorted(set(extract_tables(spark, folder)) - set(STAGED)) if tables is None else []
    found = {}
    for name in tables or [*STAGED, *own]:
        try:
            found[name] = read_extracts(spark, folder, name, splittable)
        except AnalysisException as error:
            if tables is None and error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
    stage(found, path, whole=tables is None)
    return list(found)
