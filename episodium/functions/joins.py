"""Joins of tables that both grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: it is shuffled and never goes through the driver.

    The size check goes by packed files and shuffle blocks, which a hashed table in memory exceeds
    many times, so it lets tables be broadcast that the driver can't hold.
    """
    return rows.hint("merge")
