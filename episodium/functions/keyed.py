"""Keyed choices: random-looking, but a pure function of a seed and the row's own key.

A retried task or a second run makes the same choice, and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: object, *key: Column | str) -> Column:
    """Hex digest of the seed and the key columns."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def long_hash(seed: object, *key: Column | str) -> Column:
    """A hex digest of 64 digits of the seed and the key columns, for callers that cut it in slices."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_to_int(digest: Column, start: int | Column = 1, digits: int | Column = 8) -> Column:
    """The integer that ``digits`` hex digits of a digest spell."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def keyed_int(n: Column | int, seed: object, *key: Column | str) -> Column:
    """A keyed choice from ``0..n-1``."""
    return hash_to_int(keyed_hash(seed, *key)) % n


def keyed_unit(seed: object, *key: Column | str) -> Column:
    """A keyed number strictly between 0 and 1."""
    return (hash_to_int(keyed_hash(seed, *key)) + F.lit(0.5)) / F.lit(float(2**32))


def sql_hash(seed: object, *key: str) -> str:
    """The digest of :func:`keyed_hash` as SQL text."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


def sql_long_hash(seed: object, *key: str) -> str:
    """The digest of :func:`long_hash` as SQL text."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"sha256(concat_ws('|', '{seed}', {parts}))"


def sql_int(n: object, seed: object, *key: str) -> str:
    """The choice of :func:`keyed_int` as SQL text."""
    return f"(('0x' || substr({sql_hash(seed, *key)}, 1, 8))::BIGINT % {n})"
