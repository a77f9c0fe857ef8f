"""Distributed radix sort, least significant digit first.

Rows have a position.  A pass takes one digit of the key: each block of positions counts its digits,
prefix sums over (digit, block) give where a block's rows of a digit begin, and a row's new position
is that start plus its rank among them.  Equal digits keep their order, so after the last digit the
positions are the final ranks.  A pass shuffles the narrow rows (key, position) once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodium.workspace import settle

DIGIT_BITS = 12
#: A block has so many positions; counts are one row per block and digit.
BLOCK_ROWS = 1 << 20


def ascending(value: Column) -> Column:
    """A long whose bits, read as an unsigned number, sort as ``value`` does."""
    return value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def descending(value: Column) -> Column:
    return F.bitwise_not(ascending(value))


def _digit(key: str, shift: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def _pass(rows: DataFrame, key: str, shift: int) -> DataFrame:
    """``rows`` with the positions of a stable counting sort by one digit."""
    rows = rows.withColumns({"digit": _digit(key, shift), "block": F.col("position").bitwiseAND(F.lit(-BLOCK_ROWS))})
    counts = settle(rows.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n")), "digit-counts")
    # one row per digit: at most 2**DIGIT_BITS
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()
    base, starts = 0, []
    for row in sorted(digits):
        starts.append((row["digit"], base))
        base += row["n"]
    starts = rows.sparkSession.createDataFrame(starts, "digit int, base long")
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(starts), "digit").select(
        "digit", "block", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start")
    )
    rank = F.row_number().over(Window.partitionBy("digit", "block").orderBy("position"))
    placed = rows.withColumn("rank", rank).join(offsets, ["digit", "block"])
    return placed.withColumn("position", F.col("start") + F.col("rank") - 1).select(*rows.columns[:-2])


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, Column]], name: str = "rank") -> DataFrame:
    """``rows`` with their rank, 1, 2, 3 ..., by ``keys``, the first the most significant.

    Keys are (name of a new column, :func:`ascending` or :func:`descending` of a long); the new
    columns are not in the result.  Only digits in which the rows' keys differ have a pass.  Rows
    alike in all keys get different ranks, in no stated order; keys must not be null.
    """
    named = rows.withColumns(dict(keys)).withColumn("position", F.monotonically_increasing_id())
    sorted_rows = settle(named, "radix")
    one = sorted_rows.agg(*[F.bit_and(k).alias("a" + k) for k, _ in keys], *[F.bit_or(k).alias("o" + k) for k, _ in keys]).first()
    for key, _ in reversed(keys):
        varying = ((one["a" + key] or 0) ^ (one["o" + key] or 0)) & ((1 << 64) - 1)
        for shift in range(0, 64, DIGIT_BITS):
            if varying >> shift & ((1 << DIGIT_BITS) - 1):
                sorted_rows = settle(_pass(sorted_rows, key, shift), "radix")
    if not any((one["a" + k] or 0) ^ (one["o" + k] or 0) for k, _ in keys):
        # all keys alike: one pass makes the positions dense
        sorted_rows = settle(_pass(sorted_rows, keys[0][0], 0), "radix")
    return sorted_rows.select(*rows.columns, (F.col("position") + 1).alias(name))
