"""Row positions that do not need one task per group.

``row_number() over (partition by task order by …)`` sends a whole task to one executor core.
Here a group is cut into slices that follow the order, each slice is ranked on its own, and the
slice's start comes from a prefix sum over slice counts.  The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodium.workspace import settle


def _names(prefix: str, count: int) -> list[str]:
    return [f"__{prefix}{i}" for i in range(count)]


def sliced_index(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slices: list[Column],
    name: str = "t",
) -> DataFrame:
    """0-based position of each row in its group.

    ``slices`` must not decrease along ``order``; ties in ``order`` must not matter to the caller.
    """
    cut = _names("slice", len(slices))
    sliced = df.select("*", *[s.alias(c) for s, c in zip(slices, cut, strict=True)])
    right = _names("key", len(keys) + len(cut))
    before = W.partitionBy(*keys).orderBy(*cut).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, *cut)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *[F.col(k).alias(r) for k, r in zip([*keys, *cut], right, strict=True)],
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        )
    )
    inside = W.partitionBy(*keys, *cut).orderBy(*order)
    ranked = sliced.withColumn("__inside", F.row_number().over(inside))
    same = [
        F.col(k).eqNullSafe(F.col(r)) for k, r in zip([*keys, *cut], right, strict=True)
    ]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    return ranked.join(starts, condition).select(
        *df.columns, (F.col("__start") + F.col("__inside") - 1).cast("bigint").alias(name)
    )


def running_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "t") -> DataFrame:
    """0-based position in a group that is small by nature, such as the steps of an episode.

    One window, one shuffle; a large group spills while it is sorted.  Groups that grow with the data
    (a task, a split, a table) take :func:`sliced_index` or :func:`dense_index`.
    """
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(name, position.cast("bigint"))


def hash_index(
    df: DataFrame,
    keys: list[str],
    digest: str,
    tie: list[str],
    name: str = "t",
    digits: int = 3,
) -> DataFrame:
    """0-based position by a hex digest column; ``16 ** digits`` even slices per group."""
    return sliced_index(
        df,
        keys,
        [F.col(digest), *[F.col(c) for c in tie]],
        [F.substring(F.col(digest), 1, digits)],
        name,
    )


def dense_index(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """0-based position over the whole table by a ``key`` of any kind and distribution.

    Ranges between sampled quantiles of the key give even partitions, each sorted on its own.  They
    are written once, so that the rows that are counted and those that are numbered are the same; a
    partition's start is the sum over those before it, one row per partition.  Rows with equal keys
    get different positions, in no stated order.
    """
    ranged = (
        df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__row", F.monotonically_increasing_id())
    )
    ranged = settle(ranged, "ranged")
    part = F.shiftrightunsigned("__row", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # groups of partitions, then the partitions of a group: no window sees more than some hundreds of rows
    group = F.shiftright("__part", 9)
    groups = counts.groupBy(group.alias("__group")).agg(F.sum("__n").alias("__total"))
    earlier = W.orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    bases = groups.select("__group", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__base"))
    inside = W.partitionBy("__group").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        counts.withColumn("__group", group)
        .withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(bases, "__group")
        .select("__part", (F.col("__base") + F.col("__before")).alias("__start"))
    )
    position = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("__part", part)
        .join(starts, "__part")
        .select(*df.columns, position.cast("bigint").alias(name))
    )


def contiguous_share(index: Column, total: Column, parts: int | Column) -> Column:
    """Which of ``parts`` contiguous shares row ``index`` of ``total`` falls in.

    The first ``total % parts`` shares hold one row more than the others.
    """
    parts = F.lit(parts) if isinstance(parts, int) else parts
    small = F.floor(total / parts)
    extra = total % parts
    edge = extra * (small + 1)
    return F.when(index < edge, F.floor(index / (small + 1))).otherwise(
        extra + F.floor((index - edge) / F.greatest(small, F.lit(1)))
    ).cast("bigint")
