"""Exact duplicates by two-pass Bloom filtering.

Pass one counts how often each of two filter positions of a text's hash is set; positions set at
least twice make up the filter of possibly repeated texts.  Pass two probes it: a text with a
position outside the filter occurs once and goes straight through, only the others are shuffled and
grouped by their digest.  The filter has eight bits for each row; it is broadcast up to a checked
size and joined by shuffle beyond.  A hot text is pre-aggregated in every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium.llm.common import column, fold, free_names, small
from episodium.workspace import settle

BITS_PER_ROW = 8


def _positions(key: Column, bits: int) -> Column:
    """The two filter positions of a key, as word * 64 + bit; once if they are equal."""
    mask = F.lit(bits - 1)
    return F.array_distinct(
        F.array(
            F.xxhash64(key).bitwiseAND(mask),
            F.xxhash64(F.lit("second"), key).bitwiseAND(mask),
        )
    )


def repeat_filter(keys: DataFrame, key: str, rows: int) -> tuple[DataFrame, int, int]:
    """(filter of the positions set at least twice, its number of words, its number of bits)."""
    bits = 1 << max(10, (max(1, rows) * BITS_PER_ROW - 1).bit_length())
    twice = (
        keys.select(F.explode(_positions(F.col(key), bits)).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    words = twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")
    )
    words = settle(words, "repeat-filter")
    return words, words.count(), bits


def probe(rows: DataFrame, key: Column, words: DataFrame, n_words: int, bits: int, hit: str) -> DataFrame:
    """``rows`` with a boolean column ``hit``: all positions of the key are in the filter."""
    first, last, w1, b1, w2, b2 = free_names(rows, "_p1", "_p2", "_w1", "_b1", "_w2", "_b2")
    places = _positions(key, bits)
    rows = rows.withColumn(first, F.element_at(places, 1)).withColumn(last, F.element_at(places, -1))
    one = small(words.select(F.col("word").alias(w1), F.col("bits").alias(b1)), n_words)
    two = small(words.select(F.col("word").alias(w2), F.col("bits").alias(b2)), n_words)
    joined = rows.join(one, F.shiftright(column(rows, first), 6) == F.col(w1), "left").join(
        two, F.shiftright(column(rows, last), 6) == F.col(w2), "left"
    )

    def is_set(bits_name: str, place: str) -> Column:
        return F.coalesce(
            F.expr(f"shiftright(`{bits_name}`, cast(`{place}` & 63 as int)) & 1L") == 1, F.lit(False)
        )

    return joined.withColumn(hit, is_set(b1, first) & is_set(b2, last)).drop(first, last, w1, b1, w2, b2)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they agree after lower-casing A-Z; null counts as the empty text.  The
    largest id of a group stays (a null id is below all others).  Of rows that repeat that id and
    the text one stays.  An empty table gives no rows; further columns are not read.
    """
    keys = settle(
        docs.select(
            column(docs, id_col).alias("doc_id"),
            F.unhex(F.sha2(fold(column(docs, text_col)), 256)).alias("key"),
        ),
        "text-keys",
    )
    words, n_words, bits = repeat_filter(keys, "key", keys.count())
    probed = probe(keys, F.col("key"), words, n_words, bits, "hit")
    single = probed.filter(~F.col("hit")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "key",
    )
    cells = (
        probed.filter("hit").groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    )
    groups = settle(
        cells.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")),
        "text-groups",
    )
    grouped = (
        cells.join(groups, "key")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "key",
        )
    )
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole, by the rule of :func:`duplicates`.

    Rows that the filter shows to be unique are not shuffled; of the others one row for each task
    and text is.  Among rows equal in id and text any one stays.
    """
    key, hit, row = free_names(docs, "_key", "_hit", "_row")
    keyed = docs.withColumn(key, F.unhex(F.sha2(fold(column(docs, text_col)), 256)))
    keys = settle(keyed.select(F.col(key).alias("key")), "text-keys")
    words, n_words, bits = repeat_filter(keys, "key", keys.count())
    probed = probe(keyed, F.col(key), words, n_words, bits, hit)
    columns = [f"`{c}`" for c in docs.columns]
    single = probed.filter(~F.col(hit)).select(*columns)
    best = (
        probed.filter(F.col(hit))
        .select(key, F.struct(column(docs, id_col)).alias(hit), F.struct(*columns).alias(row))
        .groupBy(key)
        .agg(F.max_by(row, hit).alias(row))
        .select(*[F.col(f"{row}.{c}") for c in columns])
    )
    return single.unionByName(best)
