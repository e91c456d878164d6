"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_present(names: Sequence[str]) -> Column:
    """True when none of the named columns is NULL."""
    return F.expr(" AND ".join(f"{n} IS NOT NULL" for n in names))


def differs(left: str, right: str, names: Sequence[str]) -> Column:
    """True when some attribute differs; a NULL on either side is no difference by itself."""
    return F.expr(" OR ".join(f"{left}.{n} <> {right}.{n}" for n in names))


def line_count(text: str) -> str:
    """Pieces of a text between newlines: a trailing newline counts one more, NULL is 0.

    Lengths, not a split or a match list: neither builds an array of the text's lines.
    """
    return f"coalesce(length({text}) - length(replace({text}, '\\n', '')) + 1, 0)"


def literal(value: str) -> str:
    """A text as an SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def listed(values: Iterable[str]) -> str:
    """Texts as the inside of an SQL IN list."""
    return ", ".join(map(literal, values))


def shown(pairs: dict[str, Column]) -> Column:
    """``name=value, name=value`` text; NULL is spelled out so that nothing shifts."""
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit("NULL"))) for n, c in pairs.items()]
    return F.concat_ws(", ", *parts)


def quoted(name: str) -> str:
    """A column name for SQL text, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"
