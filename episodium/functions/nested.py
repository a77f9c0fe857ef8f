"""Nested columns of any depth: padding, stacking, joining and cutting, by a walk over the schema.

A nested value is a struct of structs and arrays; its leaves are the arrays and scalars inside the
structs.  What is done to a value is done to each of its leaves.  The expressions are built from the
schema before a job starts; rows are worked on without Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodium.functions.arrays import pad_to

Leaf = Callable[[str, T.DataType, Column], Column]


def map_leaves(value: Column, kind: T.DataType, change: Leaf, path: str = "") -> Column:
    """``value`` with each leaf replaced by ``change(path, type, leaf)``; structs stay as they are."""
    if not isinstance(kind, T.StructType):
        return change(path, kind, value)
    fields = [
        map_leaves(value[f.name], f.dataType, change, f"{path}.{f.name}" if path else f.name).alias(f.name)
        for f in kind.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def leaves(kind: T.DataType, path: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of every leaf."""
    if not isinstance(kind, T.StructType):
        return [(path, kind)]
    return [x for f in kind.fields for x in leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]


def depth(kind: T.DataType) -> int:
    """How many arrays are within one another."""
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def innermost(kind: T.DataType) -> T.DataType:
    return innermost(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def largest_sizes(array: Column, kind: T.DataType) -> list[Column]:
    """The largest size at each depth of an array, 0 where there is none."""
    if not isinstance(kind, T.ArrayType):
        return []

    def inner(level: int) -> Callable[[Column], Column]:
        return lambda x: largest_sizes(x, kind.elementType)[level]

    levels = range(depth(kind.elementType))
    largest = [F.array_max(F.transform(array, inner(level))) for level in levels]
    return [F.coalesce(size, F.lit(0)) for size in (F.size(array), *largest)]


def padded(array: Column, kind: T.DataType, sizes: list[Column], filler: Column) -> Column:
    """An array filled up to ``sizes``, one for each depth; missing arrays are all filler."""
    if not isinstance(kind, T.ArrayType):
        return F.coalesce(array, filler)
    blank = filler
    for size in reversed(sizes[1:]):
        blank = F.array_repeat(blank, size.cast("int"))
    inner = F.transform(array, lambda x: padded(x, kind.elementType, sizes[1:], filler))
    whole = F.coalesce(inner, F.array().cast(T.ArrayType(kind.elementType)))
    return pad_to(whole, sizes[0], blank)


def default_filler(kind: T.DataType) -> Column:
    """0, false or an empty text."""
    base = innermost(kind)
    value = "" if isinstance(base, T.StringType) else False if isinstance(base, T.BooleanType) else 0
    return F.lit(value).cast(base)


def collate(rows: DataFrame, batch: str, columns: list[str], fillers: Mapping[str, object] | None = None) -> DataFrame:
    """Rows with each array in ``columns`` filled up to the largest of its batch, at every depth.

    Columns are arrays or structs with arrays, of any depth.  ``fillers`` name a value by column or
    path (``actions``, ``observations.objects.mask``); others take 0, false or an empty text.  Sizes
    come from one aggregate per batch with partial sums, so a batch is never held in one task.
    """
    fillers = dict(fillers or {})
    sizes, found = [], {}
    for name in columns:
        for path, kind in leaves(rows.schema[name].dataType, name):
            for level, size in enumerate(largest_sizes(F.col(path), kind)):
                found[path, level] = f"__s{len(sizes)}"
                sizes.append(F.max(size).alias(found[path, level]))
    largest = rows.groupBy(batch).agg(*sizes) if sizes else rows.select(batch).distinct()

    def filler_of(path: str, kind: T.DataType) -> Column:
        known = [p for p in fillers if path == p or path.startswith(p + ".")]
        return F.lit(fillers[max(known, key=len)]).cast(innermost(kind)) if known else default_filler(kind)

    def fill(path: str, kind: T.DataType, leaf: Column) -> Column:
        levels = [F.col(found[path, i]) for i in range(depth(kind))]
        return padded(leaf, kind, levels, filler_of(path, kind)) if levels else leaf

    joined = rows.join(largest, batch)
    changed = {n: map_leaves(F.col(n), rows.schema[n].dataType, fill, n) for n in columns}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])


def stack(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per group: each column becomes the array of its values, in order.

    A struct stays a struct, of arrays.  Groups are sequences that fit in a row, such as a batch.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    grouped = rows.groupBy(*by).agg(packed.alias("__rows"))

    def spread(kind: T.DataType, path: list[str]) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[spread(f.dataType, [*path, f.name]).alias(f.name) for f in kind.fields])

        def at(row: Column) -> Column:
            for name in path:
                row = row[name]
            return row

        return F.transform("__rows", at)

    return grouped.select(*by, *[spread(rows.schema[c].dataType, [c]).alias(c) for c in columns])


def concat(first: Column, second: Column, kind: T.DataType) -> Column:
    """Each leaf array of ``first`` followed by that of ``second``; both have the type ``kind``."""
    if isinstance(kind, T.StructType):
        return F.struct(*[concat(first[f.name], second[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.concat(first, second) if isinstance(kind, T.ArrayType) else F.array(first, second)


def cut(value: Column, kind: T.DataType, start: int, length: int) -> Column:
    """``length`` elements of each leaf array from place ``start`` (from 0) on; scalars stay."""
    return map_leaves(
        value, kind, lambda _, k, x: F.slice(x, start + 1, length) if isinstance(k, T.ArrayType) else x
    )


def transpose(value: Column, kind: T.DataType) -> Column:
    """The first two axes of each leaf exchanged; its inner arrays are of one size, as after padding."""

    def turned(path: str, found: T.DataType, x: Column) -> Column:
        if depth(found) < 2:
            raise ValueError(f"{path or 'value'} has no two axes")
        width = F.coalesce(F.size(F.get(x, F.lit(0))), F.lit(0))
        places = F.filter(F.sequence(F.lit(0), width), lambda i: i < width)
        return F.transform(places, lambda i: F.transform(x, lambda row: F.get(row, i)))

    return map_leaves(value, kind, turned)


def add_batch_dim(value: Column, kind: T.DataType) -> Column:
    """Each leaf as the only element of an array."""
    return map_leaves(value, kind, lambda _, __, x: F.array(x))
