"""Spelling variants by a permuterm table: all rotations of the words, sorted.

A word gets an end mark and is turned to each of its places.  Words that differ by one replaced
character share a rotation but for its last character; a word with one character deleted has as a
whole rotation what the longer word's has before its last character.  So the rows of a prefix,
sorted together, are all words one edit apart at that place: at most one word that is the prefix
itself and one word for each letter.  The scan of a prefix gives each member its number of
neighbours and the most frequent of them; pairs are never built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodium.llm.common import column, fold
from episodium.llm.words import mix, powers
from episodium.workspace import settle

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: The end mark of a word; it is no letter.
END = "$"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A near word is a word's form if it is at least so many times as frequent.
FORM_RATIO = 5
#: One run of letters in so many loses a character, by a checksum of document and run.
DAMAGE_EVERY = 199
#: Prefixes of longer words are named by hashes, so that a word's rows do not grow with its square.
LONG_WORD = 64


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run) for each run of letters of each text, A-Z in lower case."""
    runs = F.regexp_extract_all(fold(column(docs, text_col)), F.lit(LETTERS), F.lit(0))
    return docs.select(column(docs, id_col).alias("doc_id"), F.explode(runs).alias("run"))


def damaged(doc_id: Column, run: Column, every: int = DAMAGE_EVERY) -> Column:
    """``run``, in one case of ``every`` without one of its characters, by a checksum of both.

    A null id counts as an empty one.
    """
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (mark % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(mark % every == 0, shorter).otherwise(run)


def frequent_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least so many code points and occurrences."""
    long_enough = words.filter(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _short_rotations(words: DataFrame) -> DataFrame:
    length, at = F.char_length("word"), F.col("at")
    placed = words.filter(length <= LONG_WORD + 1).select(
        "id", "n", "word", F.explode(F.sequence(F.lit(0), length)).alias("at")
    )
    front = F.substring("word", F.lit(1), at)
    edited = F.substring("word", at + 1, F.lit(1))
    before = F.substring("word", at, F.lit(1))
    turned = F.concat(F.substring("word", at + 1, length), F.lit(END), front)
    cut = F.concat(F.substring("word", at + 2, length), F.lit(END), front)
    rows = F.array(
        F.struct(turned.alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("counts")),
        F.struct(cut.alias("prefix"), F.lit(False).alias("whole"), ((at == 0) | (before != edited)).alias("counts")),
    )
    found = placed.select("id", "n", "at", length.alias("length"), F.inline(rows))
    held = (F.col("whole") & (F.col("length") <= LONG_WORD)) | (~F.col("whole") & (at < F.col("length")))
    return found.filter(held).select("prefix", "whole", "counts", "id", "n")


def _rotation_hashes(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a word's rotations, and of those without their last character, modulo 2**64."""
    n = len(codes)
    at = np.arange(n + 1)
    with np.errstate(over="ignore"):
        up, down = powers(np.uint64(base), n + 2), powers(np.uint64(pow(base, -1, 1 << 64)), n + 2)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64)) * up[:n])])
        end = mix(np.array([ord(END)], np.uint64))[0]
        turned = (sums[n] - sums) * down[at] + end * up[n - at] + sums * up[n - at + 1]
        at = at[:n]
        cut = (sums[n] - sums[1:]) * down[at + 1] + end * up[n - at - 1] + sums[:n] * up[n - at]
        return mix(turned), mix(cut)


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of long words: a prefix is named by its length and two hashes."""
    for batch in batches:
        for number, n, word in zip(*(c.to_pylist() for c in batch.columns)):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            length = len(codes)
            one, two = _rotation_hashes(codes, 0x9E3779B97F4A7C15), _rotation_hashes(codes, 0xC2B2AE3D27D4EB4F)
            kinds = [(0, length + 1, np.ones(length + 1, bool))]
            if length > LONG_WORD + 1:
                kinds.append((1, length, np.concatenate([[True], codes[1:] != codes[:-1]])))
            for kind, size, counts in kinds:
                for start in range(0, len(counts), 1 << 16):
                    part = slice(start, start + (1 << 16))
                    hashes = zip(one[kind][part].tolist(), two[kind][part].tolist())
                    names = [f"{END}{size}:{x:x}:{y:x}" for x, y in hashes]
                    rows = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.string()),
                            pa.array([kind == 0] * rows),
                            pa.array(counts[part]),
                            pa.array([number] * rows, pa.int64()),
                            pa.array([n] * rows, pa.int64()),
                        ],
                        names=["prefix", "whole", "counts", "id", "n"],
                    )


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, whole, counts, id, n): the permuterm rows of (id, word, n).

    ``whole`` rows are a word's rotations, the others those without their last character, which is
    the edited one.  ``counts`` says whether the row stands for its word where an insertion or
    deletion is counted: taking any of several equal characters in a row out gives the same word, so
    only the first does.  Prefixes of more than ``LONG_WORD`` characters and the mark are named by
    their length and two 64-bit hashes.
    """
    long_words = words.filter(F.char_length("word") > LONG_WORD).select("id", "n", "word")
    hashed = long_words.mapInArrow(
        _hashed_rotations, "prefix string, whole boolean, counts boolean, id long, n long"
    )
    return _short_rotations(words).unionByName(hashed)


def neighbour_rows(words: DataFrame) -> DataFrame:
    """(id, n_near, near, near_n): what each prefix says of each of its words (id, word, n).

    Ids are in the order of the words.  Over all prefixes, the sums of ``n_near`` count each near
    word once; ``near`` is the id of the most frequent near word there, of equal ones the first.
    """
    best_first = [F.col("n").desc(), F.col("id")]
    rows = (
        Window.partitionBy("prefix")
        .orderBy(*best_first)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    whole = F.col("whole")
    scanned = (
        rotations(words)
        .repartitionByRange("prefix")
        .sortWithinPartitions("prefix", *best_first)
        .select(
            "id",
            "whole",
            "counts",
            F.count(F.lit(1)).over(rows).alias("members"),
            F.count(F.when(whole, 1)).over(rows).alias("wholes"),
            F.count(F.when(~whole & F.col("counts"), 1)).over(rows).alias("firsts"),
            F.first(F.struct("id", "n")).over(rows).alias("best"),
            F.nth_value(F.struct("id", "n"), 2).over(rows).alias("second"),
        )
        .filter("members > 1")
    )
    replaced = F.col("members") - F.col("wholes") - 1
    inserted = F.when(F.col("counts"), F.col("wholes")).otherwise(0)
    other = F.when(F.col("best.id") == F.col("id"), F.col("second")).otherwise(F.col("best"))
    return scanned.select(
        "id",
        F.when(whole, F.col("firsts")).otherwise(replaced + inserted).alias("n_near"),
        other["id"].alias("near"),
        other["n"].alias("near_n"),
    )


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(id, root): the end of each word's chain of forms, from (id, form).

    Each form is ``FORM_RATIO`` times as frequent as its word, so a chain is no longer than the
    logarithm of the largest count ``most``; its ends are found by doubling.
    """
    found = settle(forms.select("id", F.col("form").alias("root")), "word-roots")
    reach, longest = 1, math.log(max(most, 1), FORM_RATIO)
    while reach < longest:
        ahead = found.select(F.col("id").alias("root"), F.col("root").alias("further"))
        joined = found.join(ahead, "root", "left")
        found = settle(joined.select("id", F.coalesce("further", "root").alias("root")), "word-roots")
        reach *= 2
    return found


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for rows (word, n) of distinct words.

    Two words are near if one inserted, deleted or replaced code point makes one of the other;
    ``n_near`` counts a word's near words.  ``form`` is the most frequent of them (of equal ones the
    first by code points) if it is at least ``FORM_RATIO`` times as frequent, else null, ``root`` the
    end of the chain of forms, the word itself if it has none.  Words must not hold ``END``; rows
    without a word go, an empty word is near words of one letter, and an empty table gives an empty
    one.  Words may be of any length.
    """
    sorted_words = words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")).orderBy("word")
    words = settle(sorted_words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = neighbour_rows(words).groupBy("id").agg(
        F.sum("n_near").cast("long").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
    )
    is_form = -F.col("best.less") >= F.col("n") * FORM_RATIO
    known = settle(
        words.join(near, "id", "left").select(
            "id",
            "word",
            "n",
            F.when(is_form, F.col("best.near")).alias("form"),
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    most = known.agg(F.max("n")).first()[0] or 0
    ends = roots(known.filter("form IS NOT NULL"), most)
    names = known.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    ends = ends.join(names.select(F.col("form").alias("root"), F.col("form_word").alias("root_word")), "root")
    with_form = known.filter("form IS NOT NULL").join(names, "form").join(ends, "id")
    without = known.filter("form IS NULL")
    return with_form.select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"
    ).unionByName(
        without.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`group_variants` of the letter runs of all texts, one run in ``DAMAGE_EVERY`` damaged.

    Words have at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences.  Null and empty
    texts have none; repeated rows count each; other columns are not read.
    """
    runs = letter_runs(docs, id_col, text_col)
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return group_variants(frequent_words(words))
