"""Schemas of the staged tables.

Nothing is inferred: names such as ``NA`` stay text, ``nullable`` stays text
(Oracle says Y/N, Postgres YES/NO) and integers stay integers when a value is
missing. ``pkey`` is the instance id; staging is partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(*fields: str, dma: bool = True) -> T.StructType:
    """Build a staged schema; a field is a string unless written ``name:int``."""
    names = ["pkey", "con_id:int", *fields]
    if dma:
        names += ["dma_source_id", "dma_manual_id"]
    out = T.StructType()
    for name in names:
        name, _, kind = name.partition(":")
        out.add(name, {"": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType()}[kind])
    return out


STAGED: dict[str, T.StructType] = {
    "instances": _schema(dma=False),
    "dbobjectnames": _schema("owner", "object_name", "object_type"),
    "columns": _schema(
        "owner", "table_name", "column_name", "data_type",
        "data_length:int", "data_precision:int", "data_scale:int", "nullable",
    ),
    "sourcecodedetailed": _schema("owner", "name", "type", "nr_lines:int"),
    "sourcecode": _schema("owner", "type", "sum_nr_lines:bigint"),
    "views": _schema("owner", "view_name"),
    "triggers": _schema("owner", "trigger_name", "table_name", "status"),
    "indexes": _schema(
        "owner", "index_name", "index_type", "table_owner", "table_name",
        "uniqueness", "status", "num_rows:bigint",
    ),
    "roleprivs": _schema("grantee", "granted_role"),
    "sysprivs": _schema("grantee", "privilege"),
}


def conform(df: DataFrame, table: str, **columns: str) -> DataFrame:
    """Project ``df`` onto the schema of a staged table.

    Columns are taken by name, whatever their case; ``columns`` gives SQL
    expressions instead; a column that is in neither becomes NULL (``con_id`` 1).
    """
    sources = {"con_id": "1", **{c.lower(): f"`{c}`" for c in df.columns}, **columns}
    return df.selectExpr(
        *(f"CAST({sources.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in STAGED[table])
    )
