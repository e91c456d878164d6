"""Sections of the user's own: a SQL text over the staged tables.

A text names tables as ``IDENTIFIER(:columns)`` and values by markers:
``:instance_1_id``, ``:instance_2_id``, ``:instance_1_owner``,
``:instance_2_owner``, ``:owners`` (an array) and
``:all_owners`` (true for no filter). Values are bound, never pasted.

Over many pairs there are no two ids to name. A table then has the rows of all instances compared, once for each
pair of theirs, with ``pair_id`` and ``side`` (1 or 2), and the text returns ``pair_id``, by which it groups.

``from_template`` turns a text with angle-bracket placeholders into that form.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogdiff.functions import quoted
from catalogdiff.operators.presence import Sides
from catalogdiff.operators.selection import TwoInstances
from catalogdiff.plans.sections import Comparison

# Placeholders of a template, and the column each schema filter tests.
TABLE_PLACEHOLDER = "<dataset_name>"
FILTER_PLACEHOLDERS = {
    "<w_schema_filter>": ("WHERE", "OWNER"),
    "<a_schema_filter>": ("AND", "a.OWNER"),
    "<schema_filter>": ("AND", "i1.OWNER"),
}
VALUES = ("instance_1_id", "instance_2_id", "instance_1_owner", "instance_2_owner")

# Comments and text literals, which are told apart from the code around them.
COMMENT_OR_LITERAL = re.compile(r"""(--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")""", re.DOTALL)
VALUE_PLACEHOLDER = re.compile(f"<({'|'.join(VALUES)})>")


def custom_section(text: str, comparison: Comparison) -> DataFrame:
    """Result of a custom text for a comparison."""
    sides = comparison.sides
    two = isinstance(sides, TwoInstances)
    if any(mark in text for mark in ("<instance_", TABLE_PLACEHOLDER, *FILTER_PLACEHOLDERS)):
        text = from_template(text, sides)
    spark = comparison.staging["instances"].sparkSession
    owner_1, owner_2 = (comparison.owner_maps or [(None, None)])[0]
    args = {
        **({"instance_1_id": sides.first, "instance_2_id": sides.second} if two else {}),
        "instance_1_owner": owner_1,
        "instance_2_owner": owner_2,
        # An argument has to be a plain array of text, and an empty one is not; no owner is named ''.
        "owners": F.array(*map(F.lit, comparison.owners or [""])),
        "all_owners": comparison.owners is None,
    }
    prefix = f"staged_{uuid.uuid4().hex}_"
    named = [t for t in re.findall(r"IDENTIFIER\(\s*:(\w+)\s*\)", text) if t not in args]
    try:
        for table in set(named):
            rows = comparison.staging[table] if two else sides.tag(comparison.table(table, own=True))
            rows.createOrReplaceTempView(prefix + table)
            args[table] = prefix + table
        # Only what the text uses may be passed.
        used = set(re.findall(r":(\w+)", text))
        if not two and used & {"instance_1_id", "instance_2_id"}:
            raise ValueError("a custom section over many pairs has no two ids to name, but pair_id and side")
        found = spark.sql(text, args={k: v for k, v in args.items() if k in used})
        if not two and "pair_id" not in found.columns:
            raise ValueError("a custom section over many pairs returns pair_id")
        return found
    finally:
        # The result has resolved the views; their names are no longer needed.
        for table in set(named):
            spark.catalog.dropTempView(prefix + table)


def from_template(text: str, sides: Sides) -> str:
    """Placeholders → markers; an id inside a column name becomes a quoted name.

    Inside a text literal a placeholder is joined to the text around it. Comments are left
    out, and a placeholder that cannot be resolved fails; over many pairs the ids cannot.
    """
    if not isinstance(sides, TwoInstances):
        if "<instance_" in COMMENT_OR_LITERAL.sub(lambda m: " " if m[0][0] in "-/" else m[0], text):
            raise ValueError("a template that names the two instances has no meaning over many pairs")
        sides = TwoInstances("1", "2")
    ids = {"1": sides.first, "2": sides.second}

    def name_with_id(match: re.Match) -> str:
        return quoted(ids[match[1]] + match[2])

    def literal_with_values(literal: str) -> str:
        mark, pieces = literal[0], VALUE_PLACEHOLDER.split(literal[1:-1])
        if len(pieces) == 1:
            return literal
        parts = [f":{p}" if i % 2 else f"{mark}{p}{mark}" for i, p in enumerate(pieces) if p]
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    def code(part: str) -> str:
        for mark, (word, column) in FILTER_PLACEHOLDERS.items():
            part = part.replace(mark, f"{word} (:all_owners OR array_contains(:owners, {column}))")
        part = re.sub(r"<instance_([12])_id>(\w*)", name_with_id, part)
        part = re.sub(re.escape(TABLE_PLACEHOLDER) + r"\.(\w+)", lambda m: f"IDENTIFIER(:{m[1].lower()})", part)
        if left := re.search(f"{TABLE_PLACEHOLDER}|{VALUE_PLACEHOLDER.pattern}", part):
            raise ValueError(f"a placeholder stands where it has no meaning: {left[0]}")
        return part

    parts = COMMENT_OR_LITERAL.split(text)
    done = [code(p) if not i % 2 else " " if p[0] in "-/" else literal_with_values(p) for i, p in enumerate(parts)]
    return "".join(done)
