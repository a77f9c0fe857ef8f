"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the word and line rules: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: A table of at most this many small rows may be broadcast.
BROADCAST_ROWS = 1 << 20


def fold(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def free_names(frame: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``frame``, whatever its columns are called."""
    taken = {c.lower() for c in frame.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def column(frame: DataFrame, name: str) -> Column:
    """A column by its plain name, also when the name has dots or blanks."""
    return frame[f"`{name}`"]


def small(frame: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` with a broadcast hint if its known number of rows is within the limit."""
    return F.broadcast(frame) if rows <= limit else frame
