"""Importance resampling towards a target text.

Hashed features (runs of one to three words) are counted over the source and the target.  The log
ratio of the two smoothed frequencies is a feature's gain; an array of one gain per bucket scores
all features of a document at once.  The highest scores, with noise that makes the draw a sample
without replacement, are drawn, and a distributed radix sort ranks them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium.llm.common import column
from episodium.llm.radix_sort import ascending, descending, radix_ranks
from episodium.llm.words import PUNCTUATION, blocks
from episodium.workspace import settle

BUCKETS = 10000
LONGEST_RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = "42"
#: Scores are cut into at most so many bins to find where the draw ends.
BINS = 1 << 16

#: Upper-case letters become lower-case ones, all that parts words a blank.
_CLEAN = bytes(32 if PUNCTUATION[i] else i + 32 if 65 <= i <= 90 else i for i in range(256))


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """The checksum's table: what one more byte makes of the lowest one."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values


def _after(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` moved on by the zero bytes that ``table`` stands for."""
    out = table[0, values & 255]
    for place in range(1, 4):
        out = out ^ table[place, (values >> np.uint32(8 * place)) & np.uint32(255)]
    return out


@lru_cache(maxsize=4096)
def _shift_table(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of a checksum, by each of its four bytes; by halving."""
    places = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    if length == 0:
        return places
    if length == 1:
        return _byte_table()[places & 255] ^ (places >> 8)
    half = _shift_table(length // 2)
    return _after(_shift_table(length % 2), _after(half, half))


def _followed(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of a + b, from those of a and of b and the lengths of b."""
    sizes, of = np.unique(lengths, return_inverse=True)
    tables = np.stack([_shift_table(int(n)) for n in sizes])
    out = second.copy()
    for place in range(4):
        out ^= tables[of, place, (first >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def feature_buckets(
    texts: list[str | None], n_buckets: int = BUCKETS, longest: int = LONGEST_RUN
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, number of words of each, [(text, bucket)]) in blocks of bounded size.

    The features of a text are its runs of 1 .. ``longest`` words joined by one blank; a feature's
    bucket is the unsigned CRC-32 of its UTF-8 bytes modulo ``n_buckets``.
    """
    for first, last in blocks(texts):
        split = [(t or "").encode().translate(_CLEAN).split(b" ") for t in texts[first:last]]
        found = [[w for w in words if w] for words in split]
        counts = np.array([len(w) for w in found])
        words = [w for part in found for w in part]
        marks = np.fromiter(map(crc32, words), np.uint32, len(words))
        blanked = np.fromiter((crc32(b" " + w) for w in words), np.uint32, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        texts_of = np.repeat(np.arange(last - first), counts)
        rows, buckets, runs = [texts_of], [marks % np.uint32(n_buckets)], marks
        for size in range(2, longest + 1):
            runs = _followed(runs[:-1], blanked[size - 1 :], lengths[size - 1 :]) if len(runs) > 1 else runs[:0]
            inside = texts_of[: len(runs)] == texts_of[size - 1 : size - 1 + len(runs)]
            rows.append(texts_of[: len(runs)][inside])
            buckets.append((runs % np.uint32(n_buckets))[inside])
        yield first, last, counts, np.stack([np.concatenate(rows), np.concatenate(buckets).astype(np.int64)])


def bucket_counts(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """The number of features in each bucket, over all rows: ``BUCKETS`` numbers for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, features in feature_buckets(batch.column(0).to_pylist()):
                total += np.bincount(features[1], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = rows.select(column(rows, text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A feature's gain by its bucket, in thousandths: the log ratio of the smoothed frequencies."""
    s, t = int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    ratios = [(n + 1) * float(s + BUCKETS) / ((m + 1) * float(t + BUCKETS)) for m, n in pairs]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of its features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weights = (np.zeros(n, np.int64) for _ in range(3))
            for first, last, counts, (rows, buckets) in feature_buckets(batch.column(1).to_pylist()):
                n_words[first:last] = counts
                n_features[first:last] = np.bincount(rows, minlength=last - first)
                np.add.at(weights[first:last], rows, gain[buckets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weights)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, by a digest of seed and id; a null id counts as an empty one."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _is_candidate(fit: DataFrame, low: int, high: int, wanted: int) -> Column:
    """Whether a row may be among the ``wanted`` highest scores, by bins of scores."""
    width = max(-(-(high - low + 1) // BINS), 1)
    number = F.floor((F.lit(high) - F.col("score")) / F.lit(width))
    held, last = 0, -1
    for last, n in sorted(map(tuple, fit.groupBy(number).count().collect())):
        held += n
        if held >= wanted:
            break
    return number <= last


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``.

    ``weight`` is the sum of the gains of all features of a text, repeats counted, ``score`` the
    weight with noise.  Of the rows with ``min_words`` words and more, ``percent`` in a hundred
    (rounded down) with the highest scores are drawn; ``rank`` counts them from 1, ties going to the
    smaller id and a null id last.  Others have no rank.  Null and empty texts have no features and
    weight 0; repeated rows count each; other columns are not read; empty tables give no gains or no
    rows.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    weighed = weigh(docs, gain, id_col, text_col)
    scored = settle(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    is_fit = F.col("n_words") >= min_words
    fit = scored.filter(is_fit)
    total, low, high = fit.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    wanted = total * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*columns, unranked)
    in_reach = _is_candidate(fit, low, high, wanted)
    keys = [
        ("by_score", descending(F.col("score") - low)),
        ("by_null", F.col("doc_id").isNull().cast("long")),
        ("by_id", ascending(F.coalesce(F.col("doc_id"), F.lit(0)))),
    ]
    ranked = radix_ranks(fit.filter(in_reach).select(*columns), keys)
    drawn = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~(is_fit & in_reach)).select(*columns, unranked))
