"""Raw Oracle dictionary views → staged tables.

``raw`` maps a dictionary view's name without its scope prefix to a DataFrame.
With ``pkey`` given they describe one database; without, each has a ``pkey``
column and holds many databases. In scope ``user`` the views have no owner
column and show no system accounts: the owner is the connecting ``user``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from catalogdiff.functions import listed, literal
from catalogdiff.operators.selection import described, filter_owners
from catalogdiff.schemas import conform

Raw = Mapping[str, DataFrame]

# Fixed values.
SCOPES = ("user", "all", "dba")
SYSTEM_OWNERS = ("SYS", "SYSTEM")
TEXT_INDEX_NAMES = "DR$IDX_%"
TEXT_INDEX_NOTE = " *Warning: FULL TEXT SEARCH INDEX*"


class _Dictionary:
    def __init__(self, raw: Raw, pkey: str | None, owners: Sequence[str] | None, scope: str, user: str | None):
        if scope not in SCOPES:
            raise ValueError(f"scope is one of {SCOPES}")
        if scope == "user" and not user:
            raise ValueError("scope 'user' needs the connecting user")
        self.raw, self.pkey, self.owners = raw, pkey, owners
        self.user = user if scope == "user" else None
        self.db = [] if pkey is not None else ["pkey"]

    def rows(self, name: str, owned: bool = True) -> DataFrame:
        """Rows of a view with their raw owner; owners are compared as typed, before folding."""
        rows = self.raw[name]
        if not owned:
            return rows
        if self.user is not None:
            rows = rows.selectExpr("*", f"{literal(self.user)} AS owner")
        else:
            rows = rows.where(f"owner NOT IN ({listed(SYSTEM_OWNERS)})")
        return filter_owners(rows, self.owners)

    def stage(self, df: DataFrame, table: str, **columns: str) -> DataFrame:
        if self.pkey is not None:
            columns["pkey"] = literal(self.pkey)
        return conform(df, table, owner="upper(owner)", dma_source_id="'Oracle'", con_id="1", **columns)


def ora_instance(raw: Raw, pkey: str | None = None) -> DataFrame:
    """One row per database described."""
    objects = raw["objects"]
    if pkey is None:
        return conform(described(raw), "instances")
    return conform(objects.sparkSession.range(1), "instances", pkey=literal(pkey))


def ora_columns(
    raw: Raw,
    pkey: str | None = None,
    owners: Sequence[str] | None = None,
    scope: str = "dba",
    user: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Columns as the dictionary lists them; ``ordered`` sorts by owner, table and position."""
    d = _Dictionary(raw, pkey, owners, scope, user)
    rows = d.rows("tab_columns")
    if ordered:
        rows = rows.orderBy("owner", "table_name", "column_id")
    return d.stage(rows, "columns")


def ora_views(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, scope: str = "dba", user: str | None = None
) -> DataFrame:
    d = _Dictionary(raw, pkey, owners, scope, user)
    return d.stage(d.rows("views"), "views")


def ora_objects(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, scope: str = "dba", user: str | None = None
) -> DataFrame:
    """Objects without LOB segments; a partition is named after its table, a partitioned table typed as one."""
    d = _Dictionary(raw, pkey, owners, scope, user)
    match = [*d.db, "object_name"] if d.user is not None else [*d.db, "owner", "object_name"]
    names = [*d.db, "table_name AS object_name"] + ([] if d.user is not None else ["table_owner AS owner"])
    # Distinct tables, not partitions: a flag must not repeat rows, and a table
    # of very many partitions is one row before the exchange.
    partitioned = d.rows("tab_partitions", owned=False).selectExpr(*names).distinct()
    rows = d.rows("objects").where("object_type NOT IN ('LOB')")
    rows = rows.join(partitioned.selectExpr("*", "true AS _partitioned"), match, "left")
    return d.stage(
        rows,
        "dbobjectnames",
        object_name="CASE WHEN object_type = 'TABLE PARTITION'"
        " THEN concat(object_name, '_', coalesce(subobject_name, ''))"
        f" WHEN object_name LIKE {literal(TEXT_INDEX_NAMES)} THEN concat(object_name, {literal(TEXT_INDEX_NOTE)})"
        " ELSE object_name END",
        object_type="CASE WHEN object_type = 'TABLE' AND _partitioned THEN 'PARTITIONED TABLE' ELSE object_type END",
    )


def ora_source_lines(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, scope: str = "dba", user: str | None = None
) -> DataFrame:
    """Last line number per unit: combined before the exchange, however long one unit is."""
    d = _Dictionary(raw, pkey, owners, scope, user)
    units = d.rows("source").groupBy(*d.db, "owner", "name", "type").agg({"line": "max"})
    return d.stage(units, "sourcecodedetailed", nr_lines="`max(line)`")


def ora_triggers(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, scope: str = "dba", user: str | None = None
) -> DataFrame:
    d = _Dictionary(raw, pkey, owners, scope, user)
    return d.stage(d.rows("triggers"), "triggers")


def normalize_oracle(
    raw: Raw, pkey: str | None = None, owners: Sequence[str] | None = None, scope: str = "dba", user: str | None = None
) -> dict[str, DataFrame]:
    """All tables the Oracle collector fills."""
    how = (raw, pkey, owners, scope, user)
    return {
        "instances": ora_instance(raw, pkey),
        "columns": ora_columns(*how),
        "views": ora_views(*how),
        "dbobjectnames": ora_objects(*how),
        "sourcecodedetailed": ora_source_lines(*how),
        "triggers": ora_triggers(*how),
    }
