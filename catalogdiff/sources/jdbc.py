"""Raw catalogs over JDBC, read in parallel.

Only the columns a normaliser uses are selected at the source. A table is cut
into reads of equal size by ranges of an object's name, which the source is asked for once; not by schema, so
that one large schema is spread as well. Connection options come from the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from catalogdiff.operators.normalize_ora import SCOPES

FETCH_SIZE = 10_000
# Read on request only: no normaliser needs them, and grants of other users are in DBA views.
ON_REQUEST = ("indexes", "role_privs", "sys_privs")

# Catalog table → (SELECT list and FROM, expression to spread reads by).
POSTGRES: dict[str, tuple[str, str]] = {
    "pg_namespace": ("oid::bigint AS oid, nspname::text AS nspname FROM pg_namespace", "nspname"),
    "pg_class": (
        "oid::bigint AS oid, relname::text AS relname, relnamespace::bigint AS relnamespace,"
        " relkind::text AS relkind FROM pg_class",
        "relname",
    ),
    "pg_inherits": ("inhrelid::bigint AS inhrelid, inhparent::bigint AS inhparent FROM pg_inherits", "inhrelid::text"),
    "pg_language": ("oid::bigint AS oid, lanname::text AS lanname FROM pg_language", "lanname"),
    "pg_proc": (
        "oid::bigint AS oid, proname::text AS proname, pronamespace::bigint AS pronamespace,"
        " prokind::text AS prokind, prolang::bigint AS prolang,"
        " CASE WHEN prokind <> 'a' THEN pg_get_functiondef(oid) END AS definition FROM pg_proc",
        "proname",
    ),
    "pg_trigger": (
        "oid::bigint AS oid, tgname::text AS tgname, tgrelid::bigint AS tgrelid, tgisinternal,"
        " tgenabled::text AS tgenabled FROM pg_trigger",
        "tgname",
    ),
    "columns": (
        "table_schema::text AS table_schema, table_name::text AS table_name, column_name::text AS column_name,"
        " data_type::text AS data_type, character_maximum_length::int AS character_maximum_length,"
        " numeric_precision::int AS numeric_precision, numeric_scale::int AS numeric_scale,"
        " is_nullable::text AS is_nullable FROM information_schema.columns",
        "table_name",
    ),
    "views": (
        "table_schema::text AS table_schema, table_name::text AS table_name FROM information_schema.views",
        "table_name",
    ),
}

# Dictionary view without scope prefix → (columns, expression to spread reads by).
# The owner column is left out in scope ``user``, which has none.
ORACLE: dict[str, tuple[str, str]] = {
    "tab_columns": (
        "owner, table_name, column_name, data_type, data_length, data_precision, data_scale, nullable, column_id",
        "table_name",
    ),
    "objects": ("owner, object_name, subobject_name, object_type", "object_name"),
    "tab_partitions": ("table_owner, table_name", "table_name"),
    "source": ("owner, name, type, line", "name"),
    "triggers": ("owner, trigger_name, table_name, status", "trigger_name"),
    "views": ("owner, view_name", "view_name"),
    "indexes": (
        "owner, index_name, index_type, table_owner, table_name, uniqueness, status, num_rows",
        "index_name",
    ),
    "role_privs": ("grantee, granted_role", "granted_role"),
    "sys_privs": ("grantee, privilege", "privilege"),
}


def catalog_query(dialect: str, table: str, scope: str = "dba") -> tuple[str, str]:
    """The subquery that reads a catalog table, and the expression its reads are spread by."""
    if dialect == "postgres":
        select, spread = POSTGRES[table]
        return f"(SELECT {select}) t", spread
    if dialect != "oracle":
        raise ValueError("dialect is 'oracle' or 'postgres'")
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    columns, spread = ORACLE[table]
    prefix = scope
    if table in ("role_privs", "sys_privs"):
        # Grants exist for one user or for all; there is no ALL_ view of them.
        prefix = "user" if scope == "user" else "dba"
        if scope == "user":
            columns = columns.replace("grantee", "username AS grantee")
    elif scope == "user":
        own = [c.strip() for c in columns.split(",")]
        dropped = ("owner",) if table == "indexes" else ("owner", "table_owner")
        columns = ", ".join(c for c in own if c not in dropped)
    return f"(SELECT {columns} FROM {prefix}_{table}) t", spread


def read_predicates(dialect: str, spread: str, reads: int) -> list[str]:
    """One predicate per parallel read. Together they take every row once, NULLs included."""
    if dialect == "oracle":
        return [f"MOD(ORA_HASH({spread}), {reads}) = {i}" for i in range(reads)]
    # The inner query's casts are not in scope here, its column names are.
    column = spread.partition("::")[0]
    hashed = f"HASHTEXT(COALESCE({column}::text, ''))::bigint"
    return [f"MOD(ABS({hashed}), {reads}) = {i}" for i in range(reads)]


def cut_query(query: str, spread: str, reads: int) -> str:
    """The subquery that gives the last name of each of ``reads`` equal parts of a table: ``part, cut``."""
    column = spread.partition("::")[0]
    tiles = f"SELECT {column} AS name, NTILE({reads}) OVER (ORDER BY {column}) AS part FROM {query} WHERE {column} IS NOT NULL"
    return f"(SELECT part, MAX(name) AS cut FROM ({tiles}) p GROUP BY part) c"


def range_predicates(spread: str, cuts: Sequence[str | int]) -> list[str]:
    """One predicate per range between the ``cuts``, in their order. Together they take every row once.

    A name that is many rows long ends one range only, so equal cuts are one. NULLs are in the last range.
    """
    column = spread.partition("::")[0]
    ends = [str(c) if isinstance(c, int) else "'" + str(c).replace("'", "''") + "'" for c in dict.fromkeys(cuts)][:-1]
    if not ends:
        return ["1 = 1"]
    inner = [f"{column} > {low} AND {column} <= {high}" for low, high in zip(ends, ends[1:])]
    return [f"{column} <= {ends[0]}", *inner, f"{column} > {ends[-1]} OR {column} IS NULL"]


def default_tables(dialect: str) -> list[str]:
    return [t for t in (POSTGRES if dialect == "postgres" else ORACLE) if t not in ON_REQUEST]


def read_catalog(
    spark: SparkSession,
    url: str,
    dialect: str,
    tables: Sequence[str] | None = None,
    scope: str = "dba",
    reads: int = 8,
    properties: Mapping[str, str] | None = None,
    ranges: bool = True,
) -> dict[str, DataFrame]:
    """Raw catalog tables of one database: those a normaliser needs, unless ``tables`` names others.

    With ``ranges`` the source gives the ends of ``reads`` equal ranges of names, one short query a table. Without,
    reads are by a hash of the name, each of which goes through the whole view.
    """
    names = tables or default_tables(dialect)
    options = {"fetchsize": str(FETCH_SIZE), **(properties or {})}
    out = {}
    for name in names:
        query, spread = catalog_query(dialect, name, scope)
        if ranges:
            # Sorted by part: the order of names is the source's own.
            found = spark.read.jdbc(url, cut_query(query, spread, reads), properties=options).toDF("part", "cut").collect()
            predicates = range_predicates(spread, [row["cut"] for row in sorted(found, key=lambda row: row["part"])])
        else:
            predicates = read_predicates(dialect, spread, reads)
        out[name] = spark.read.jdbc(url, query, predicates=predicates, properties=options)
    return out
