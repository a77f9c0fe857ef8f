"""Array columns: padding, zipping and slicing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodium.functions.text import let


def pad_to(array: Column, length: Column, filler: Column) -> Column:
    """The array followed by ``filler`` up to ``length``."""
    return F.concat(array, F.array_repeat(filler, F.greatest(length - F.size(array), F.lit(0)).cast("int")))


def lists_to_records(**arrays: Column) -> Column:
    """Parallel arrays to an array of structs; NULL when the lengths differ."""
    columns = list(arrays.values())
    equal = F.lit(True)
    for other in columns[1:]:
        equal = equal & (F.size(other) == F.size(columns[0]))
    return F.when(equal, F.arrays_zip(*[c.alias(n) for n, c in arrays.items()]))


def records_to_list(records: Column, field: str) -> Column:
    """One field of an array of structs."""
    return F.transform(records, lambda r: r[field])


def log_softmax_loss(logits: Column, target: Column, ignored: int) -> Column:
    """Cross-entropy of one logit vector; NULL for an ignored target."""
    loss = let(
        F.array_max(logits),
        lambda top: top
        + F.ln(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
        - F.get(logits, target.cast("int")),
    )
    return F.when(target != ignored, loss)


def argmax(values: Column) -> Column:
    """0-based position of the first greatest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")
