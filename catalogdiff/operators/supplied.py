"""Staged tables that no collector fills, taken as supplied or derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.functions import literal
from catalogdiff.schemas import conform

# Dictionary view (without scope prefix) each table comes from.
SUPPLIED = {"indexes": "indexes", "roleprivs": "role_privs", "sysprivs": "sys_privs"}


def supplied(rows: DataFrame, table: str, pkey: str | None = None, source: str | None = None) -> DataFrame:
    """Stage ``indexes``, ``roleprivs`` or ``sysprivs`` rows by column name."""
    if table not in SUPPLIED:
        raise ValueError(f"a collector fills {table}; supplied tables are {sorted(SUPPLIED)}")
    given = {"pkey": pkey, "dma_source_id": source}
    return conform(rows, table, **{name: literal(value) for name, value in given.items() if value is not None})


def sourcecode_rollup(detailed: DataFrame) -> DataFrame:
    """``sourcecode``: lines per instance, owner and type."""
    keys = [c for c in ("pkey", "con_id", "owner", "type") if c in detailed.columns]
    return detailed.groupBy(*keys).agg(F.sum("nr_lines").cast("bigint").alias("sum_nr_lines"))
