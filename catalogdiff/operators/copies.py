"""Repeat rows by a count, spread over tasks however large one count is.

A diff keeps one row per key with a number of copies (the row count a left
join would have produced). A key that holds a third of a table would make one
task write billions of rows, so a count is cut into bounded pieces first, the
pieces are rebalanced over the cluster, and only then are rows repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from catalogdiff.functions import quoted

# A count is cut into blocks, and blocks into pieces, so that no array built on
# the way is longer than count / BLOCK or BLOCK.
BLOCK = 1_000_000
PIECE = 1_000


def repeat_rows(df: DataFrame, copies: str, spread: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """Emit each row ``copies`` times (at least 1 expected) and drop the count.

    ``spread`` adds a rebalance of the pieces: one more exchange, of the rows
    given here only. Leave it off where counts come from data that cannot
    repeat much and the rows are the whole table. With ``order`` the exchange is
    that of a sort, which cuts the pieces of one row apart as well.
    """
    kept = [quoted(c) for c in df.columns if c != copies]

    def cut(rows: DataFrame, width: int, number: str, *numbers: str) -> DataFrame:
        """Split each row into numbered rows of at most ``width`` copies, keeping the total."""
        rows = rows.selectExpr("*", f"explode(sequence(0, int((`{copies}` - 1) div {width}))) AS {number}")
        return rows.selectExpr(*kept, *numbers, number, f"least({width}L, `{copies}` - {number} * {width}L) AS `{copies}`")

    pieces = cut(df, BLOCK, "_block")
    if spread or order:
        pieces = cut(pieces, PIECE, "_piece", "_block")
        pieces = pieces.orderBy(*order, "_block", "_piece") if order else pieces.hint("rebalance")
    return pieces.selectExpr(*kept, f"explode(sequence(1, int(`{copies}`))) AS _one").selectExpr(*kept)
