"""Names: instance ids, owner lists, owner maps and Postgres ``regclass`` text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogdiff.functions.text import listed

# Prefix of an instance id by dialect.
INSTANCE_PREFIX = {"oracle": "oracle_", "postgres": "postgres"}

# Key words PostgreSQL quotes when it prints an identifier
# (reserved, type/function name and column name words of its manual, appendix C).
QUOTED_WORDS = """
all analyse analyze and any array as asc asymmetric both case cast check collate column constraint
create current_catalog current_date current_role current_time current_timestamp current_user default
deferrable desc distinct do else end except false fetch for foreign from grant group having in
initially intersect into lateral leading limit localtime localtimestamp not null offset on only or
order placing primary references returning select session_user some symmetric system_user table then to trailing
true union unique user using variadic when where window with
authorization binary collation concurrently cross current_schema freeze full ilike inner is isnull
join left like natural notnull outer overlaps right similar tablesample verbose
between bigint bit boolean char character coalesce dec decimal exists extract float greatest grouping
inout int integer interval least national nchar none normalize nullif numeric out overlay position
precision real row setof smallint substring time timestamp treat trim values varchar xmlattributes
xmlconcat xmlelement xmlexists xmlforest xmlnamespaces xmlparse xmlpi xmlroot xmlserialize xmltable
""".split()


def host_to_instance_id(host: Column, dialect: str) -> Column:
    """Default instance id of a database host: its letters, or its dotted quad as ``ip_a_b_c_d``."""
    letters = F.regexp_replace(host, r"[^\p{L}]", "")
    address = F.concat(F.lit("ip_"), F.regexp_replace(host, r"\.", "_"))
    return F.concat(F.lit(INSTANCE_PREFIX[dialect]), F.when(host.rlike(r"^[0-9.]*$"), address).otherwise(letters))


def parse_owner_list(text: str | None) -> list[str] | None:
    """``"A, B"`` → ``["A", "B"]``; nothing given means no filter."""
    return [item.strip() for item in text.split(",")] if text else None


def parse_owner_map(text: str | None) -> list[tuple[str, str]] | None:
    """``"SOURCE/TARGET"`` → ``[("SOURCE", "TARGET")]``; several maps are comma-separated."""
    if not text:
        return None
    maps = []
    for item in text.split(","):
        parts = [p.strip() for p in item.split("/")]
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"an owner map reads SOURCE/TARGET, not {item!r}")
        maps.append((parts[0], parts[1]))
    return maps


def _quoted(name: str) -> str:
    plain = f"{name} RLIKE '^[a-z_][a-z0-9_]*$' AND {name} NOT IN ({listed(QUOTED_WORDS)})"
    return f"""CASE WHEN {plain} THEN {name} ELSE concat('"', replace({name}, '"', '""'), '"') END"""


def regclass_text(schema: str, name: str, search_path: Sequence[str]) -> str:
    """What Postgres prints for a relation: qualified unless its schema is on the search path."""
    on_path = f"{schema} IN ({listed(['pg_catalog', *search_path])})"
    return f"CASE WHEN {on_path} THEN {_quoted(name)} ELSE concat({_quoted(schema)}, '.', {_quoted(name)}) END"
