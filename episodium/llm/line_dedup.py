"""Line deduplication that returns keep bitmaps instead of text.

Line hashes are range-partitioned and sorted by (hash, document, position), so that the first
document of a line is streamed by a window over the sorted rows.  Hashes that an exact-bound sketch
finds to be hot skip that shuffle: their first document is a pre-aggregated minimum, broadcast (at
most ``HOT_LINES`` rows).  The result is one row per document with 64-line keep words, only as far
as the last word with a dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from episodium.llm.common import BLANKS, UPPER, column, free_names
from episodium.workspace import settle

MIN_LENGTH = 10
HOT_LINES = 256


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """(id, text_hash, keep array<long>, n_dropped) for each text that loses lines.

    ``keep`` has one word per 64 lines, bit i of word w for line 64 * w + i; lines beyond the last
    word all stay.  Rows with the same id are one document (a null id comes after all others), but
    each text has its own bitmap.
    """
    key = line_key(F.col("line"))
    lines = (
        docs.select(
            column(docs, id_col).alias("id"),
            F.xxhash64(column(docs, text_col)).alias("text_hash"),
            F.posexplode(split_lines(column(docs, text_col))).alias("pos", "line"),
        )
        .filter(F.char_length(key) >= min_length)
        .select(
            "id",
            "text_hash",
            "pos",
            F.xxhash64(key).alias("h1"),
            F.xxhash64(F.lit("second"), key).alias("h2"),
        )
    )
    lines = settle(lines, "line-hashes")
    total, top = lines.agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(h1, {HOT_LINES}, 16384)")
    ).first()
    hot = [x["item"] for x in top or [] if x["count"] * HOT_LINES >= total]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)

    order = [F.col("id").asc_nulls_last(), "pos"]
    streamed = (
        lines.filter(~is_hot)
        .repartitionByRange("h1")
        .sortWithinPartitions("h1", "h2", *order)
        .withColumn("first_id", F.first("id").over(Window.partitionBy("h1", "h2").orderBy(*order)))
    )
    parts = streamed
    if hot:
        firsts = lines.filter(is_hot).groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
        parts = streamed.unionByName(
            lines.filter(is_hot).join(F.broadcast(firsts), ["h1", "h2"]).select(*streamed.columns)
        )
    words = (
        parts.filter(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("id", "text_hash", F.shiftright("pos", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("dropped"))
    )
    listed = words.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", F.expr("~dropped").alias("keep")))).alias("words"),
        F.sum(F.bit_count("dropped")).alias("n_dropped"),
    )
    dense = F.aggregate(
        "words",
        F.array().cast("array<bigint>"),
        lambda done, w: F.concat(
            done, F.array_repeat(F.lit(-1).cast("long"), w["word"] - F.size(done)), F.array(w["keep"])
        ),
    )
    return listed.select("id", "text_hash", dense.alias("keep"), "n_dropped")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and kept_text added.

    A new column whose name ``docs`` has already gets an underscore in front.

    A key is a line without white space at its ends, A-Z in lower case.  Keys of at least
    ``MIN_LENGTH`` code points that two or more documents hold stay in the document with the
    smallest id only, there with all their lines.  Null and empty texts are one empty line.  A row
    without an id belongs to a document after all others; repeated rows of one id are one document.
    """
    keep, lost, b_id, b_hash, *added = free_names(
        docs, "_keep", "_lost", "_bid", "_bhash", "n_lines", "n_dropped", "kept_text"
    )
    maps = keep_bitmaps(docs, id_col, text_col).select(
        F.col("id").alias(b_id),
        F.col("text_hash").alias(b_hash),
        F.col("keep").alias(keep),
        F.col("n_dropped").alias(lost),
    )
    text = column(docs, text_col)
    joined = docs.join(
        maps, column(docs, id_col).eqNullSafe(F.col(b_id)) & (F.xxhash64(text) == F.col(b_hash)), "left"
    )
    lines = split_lines(text)
    kept = F.filter(
        lines,
        lambda line, i: F.coalesce(
            F.getbit(F.get(F.col(keep), F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 1, F.lit(True)
        ),
    )
    whole = F.coalesce(text, F.lit(""))
    return joined.select(
        *[column(docs, c) for c in docs.columns],
        F.size(lines).cast("long").alias(added[0]),
        F.coalesce(F.col(lost), F.lit(0)).cast("long").alias(added[1]),
        F.when(F.col(lost).isNull(), whole).otherwise(F.array_join(kept, "\n")).alias(added[2]),
    )
