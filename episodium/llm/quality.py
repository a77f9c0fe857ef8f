"""Quality and toxicity of documents by hierarchical empirical Bayes.

A linear classifier, fitted on a bounded sample of labelled documents, gives each document's evidence
as a log likelihood ratio.  Hosts and, below them, paths get posterior rates from the documents'
probabilities: a host is shrunk toward the global rate, a path toward its host, the more the fewer
documents it has; how strongly follows from the spread between hosts and between paths.  A document's
own probability is left out of the rates it is judged by.  All rates come from grouped sums over all
documents; the classifier alone sees a sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodium.llm import words
from episodium.llm.common import column, free_names
from episodium.workspace import settle

#: Labelled documents the classifier is fitted on, at most: those with the least hash of their id.
SAMPLE_ROWS = 8192
WORD_BUCKETS = 1 << 18
#: Beginnings of words, in bytes, that are features too: they stand for all forms of a word.
HEADS = (4, 5, 6)
SHAPES, SHAPE_BINS = 7, 16
#: Features are used if the classes differ in them beyond chance: their G statistic is at least this
#: and at least the root of the number of rows (copies among the rows inflate it).  So many at most.
LEAST_G, MOST_FEATURES = 15.0, 4096
FEATURES = WORD_BUCKETS + SHAPES * SHAPE_BINS
#: Rows whose features are counted at a time.
COUNTED_ROWS = 256
#: Bounds of the prior strengths, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0
EDGE = 1e-4

_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_MARKS = np.array([chr(i) in "#$%&*~^=+<>{}[]\\" for i in range(256)])


def _share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A bin for each share: 0 for none, then halving bins of the share."""
    part = flags / np.maximum(of, 1)
    return np.where(part <= 0, 0, np.clip(15 + np.floor(np.log2(np.maximum(part, 1e-9))), 1, 15)).astype(np.int64)


def features(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The feature numbers of each text: buckets of its words and their beginnings, and bins of its shape."""
    for first, last in words.blocks(texts):
        part = texts[first:last]
        found, offsets, *firsts = words.hash_words(part, words.PUNCTUATION, HEADS)
        raw = [(t or "").encode() for t in part]
        joined = b"\n".join(raw) + b"\n"
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]])

        def count(flags: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.frombuffer(joined.translate(flags.tobytes()), np.uint8), starts, dtype=np.int64)

        n_words = np.diff(offsets)
        distinct = np.array([len(words.distinct(found[a:b])) for a, b in zip(offsets[:-1], offsets[1:])])
        letters = count(_LETTER)
        one = np.zeros(256, bool)

        def of(char: str) -> np.ndarray:
            flags = one.copy()
            flags[ord(char)] = True
            return count(flags)

        bins = [
            _share(count(_UPPER), letters),
            _share(of("!"), n_words),
            _share(count(_MARKS), n_words),
            _share(of("|"), n_words),
            np.clip((distinct * 15) // np.maximum(n_words, 1), 0, 15),
            np.clip(np.log2(n_words + 1).astype(np.int64), 0, 15),
            np.clip(letters // np.maximum(n_words, 1), 0, 15),
        ]
        shape = np.stack([WORD_BUCKETS + i * SHAPE_BINS + b for i, b in enumerate(bins)], axis=1)
        with np.errstate(over="ignore"):
            parts = [found, *[words.mix(f + np.uint64(n)) for f, n in zip(firsts, HEADS)]]
        buckets = np.stack([(p % np.uint64(WORD_BUCKETS)).astype(np.int32) for p in parts], axis=1)
        for i in range(len(part)):
            yield np.concatenate([words.distinct(buckets[offsets[i] : offsets[i + 1]].ravel()), shape[i]])


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each feature is, a block of rows at a time."""
    out = np.zeros(FEATURES)
    for first in range(0, len(rows), COUNTED_ROWS):
        out += np.bincount(np.concatenate(rows[first : first + COUNTED_ROWS]), minlength=FEATURES)
    return out


def telling(found: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which features tell the classes apart, by the G statistic of their two-by-two tables."""
    rows, positive = len(found), labels.sum()
    n = _counts(found)
    both = _counts([r for r, label in zip(found, labels) if label])

    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    rate = positive / rows
    g = 2 * (
        term(both, n * rate)
        + term(n - both, n * (1 - rate))
        + term(positive - both, (rows - n) * rate)
        + term(rows - n - positive + both, (rows - n) * (1 - rate))
    )
    g[(n < 3) | (g < max(LEAST_G, rows**0.5))] = 0
    chosen = np.zeros(FEATURES, bool)
    chosen[np.argsort(-g, kind="stable")[:MOST_FEATURES]] = True
    return chosen & (g > 0)


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic regression on binary features; neutral without both classes."""
    weights = np.zeros(FEATURES)
    if len(rows) == 0 or labels.min() == labels.max():
        return weights, 0.0
    chosen = telling(rows, labels)
    told = [r[chosen[r]] for r in rows]
    flat, owner = np.concatenate(told), np.repeat(np.arange(len(rows)), [len(r) for r in told])
    rate = labels.mean()
    bias = float(np.log(rate / (1 - rate)))
    speed, bias_speed = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(steps):
        score = np.bincount(owner, weights[flat], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        slope = np.bincount(flat, error[owner], FEATURES) / len(rows) + ridge * weights
        speed += slope**2
        weights -= 0.3 * slope / np.sqrt(speed)
        bias_speed += error.mean() ** 2
        bias -= 0.1 * error.mean() / np.sqrt(bias_speed)
    return weights, bias


class Classifier:
    """Weights for the heads "quality" and "toxic", each with its intercept and its base rate."""

    def __init__(self, rows: list[np.ndarray], quality: np.ndarray, toxic: np.ndarray) -> None:
        self.heads = []
        for labels in (quality, toxic):
            weights, bias = fit(rows, labels.astype(float))
            rate = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
            neutral = not len(rows) or labels.min() == labels.max()
            self.heads.append((weights.astype(np.float32), 0.0 if neutral else bias - np.log(rate / (1 - rate))))

    def evidence(self, texts: Sequence[str | None]) -> np.ndarray:
        """Log likelihood ratios of both heads, one row per text; 0 for a text without words."""
        out = np.zeros((len(texts), len(self.heads)))
        for i, found in enumerate(features(texts)):
            if len(found) > SHAPES:
                out[i] = [float(w[found].sum(dtype=float)) + b for w, b in self.heads]
        return np.clip(out, -30, 30)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Classifier:
    """A classifier from at most ``sample_rows`` labelled documents (labels: doc_id, quality, toxic).

    Rows without id, quality or toxic are not used, and one row for each id is.
    """
    sample = (
        labels.select("doc_id", "quality", "toxic")
        .dropna()
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32) for f in features(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "quality", "toxic", "features"],
            )

    joined = (
        docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"), "text")
    )
    kind = joined.schema["doc_id"].dataType.simpleString()
    table = joined.mapInArrow(run, f"doc_id {kind}, quality long, toxic long, features array<int>").toArrow()
    # in order of the ids, without another copy of the features
    order = pc.sort_indices(table.column("doc_id")).to_numpy()
    found = [np.asarray(x.values) for chunk in table.column("features").chunks for x in chunk]
    quality, toxic = (table.column(c).to_numpy().astype(int)[order] for c in ("quality", "toxic"))
    classifier = Classifier([found[i] for i in order], quality, toxic)
    # the sample goes back to the system, else the driver keeps room for it to its end
    del table, found
    pa.default_memory_pool().release_unused()
    return classifier


def with_evidence(rows: DataFrame, text_col: str, classifier: Classifier, names: Sequence[str]) -> DataFrame:
    """``rows`` with a column of evidence for each head."""
    at, every = rows.columns.index(text_col), [*rows.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = classifier.evidence(part.column(at).to_pylist())
                columns = [*part.columns, *[pa.array(found[:, i], pa.float64()) for i in range(found.shape[1])]]
                yield pa.RecordBatch.from_arrays(columns, every)

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    return F.log(p / (1 - p))


def _strength(spread: float | None, groups: int, docs: int, mean: float) -> float:
    """Prior strength in documents, by moments: the less groups differ beyond chance, the stronger."""
    chance = mean * (1 - mean)
    beyond = (spread or 0.0) - chance * groups / max(docs, 1)
    if beyond <= 0 or chance <= 0:
        return STRONGEST
    return min(max(chance / beyond - 1, WEAKEST), STRONGEST)


def site_rates(scored: DataFrame, heads: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Grouped sums by (host, path) with the host's own, and (mean, host strength, path strength).

    ``scored`` has host, path and a probability for each head.  The sums come in one row per path:
    n_path, n_host, and s_path_<head>, s_host_<head>.
    """
    paths = settle(
        scored.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n_path"), *[F.sum(h).alias(f"s_path_{h}") for h in heads]
        ),
        "path-rates",
    )
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(
        F.sum("n_path").alias("n_host"), *[F.sum(f"s_path_{h}").alias(f"s_host_{h}") for h in heads]
    )
    rates = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    rates = settle(rates, "site-rates")
    total = rates.agg(
        F.sum("n_path").alias("n"),
        F.count(F.lit(1)).alias("paths"),
        F.sum(F.col("n_path") / F.col("n_host")).alias("hosts"),
        *[F.sum(f"s_path_{h}").alias(h) for h in heads],
    ).first()
    n = total["n"] or 0
    means = {h: (total[h] / n if n else 0.5) for h in heads}
    spreads = rates.agg(
        *[
            (F.sum(F.col("n_path") * (F.col(f"s_host_{h}") / F.col("n_host") - F.lit(means[h])) ** 2) / max(n, 1)).alias(f"host_{h}")
            for h in heads
        ],
        *[
            (F.sum(F.col("n_path") * (F.col(f"s_path_{h}") / F.col("n_path") - F.col(f"s_host_{h}") / F.col("n_host")) ** 2) / max(n, 1)).alias(f"path_{h}")
            for h in heads
        ],
    ).first()
    strengths = {
        h: (
            means[h],
            _strength(spreads[f"host_{h}"], round(total["hosts"] or 0), n, means[h]),
            _strength(spreads[f"path_{h}"], total["paths"], n, means[h]),
        )
        for h in heads
    }
    return rates, strengths


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    names: tuple[str, str, str] = ("quality", "toxic", "keep"),
    sample_rows: int = SAMPLE_ROWS,
    whole: bool = False,
) -> DataFrame:
    """The posterior probabilities of quality and toxicity of every document, and whether to keep it.

    The result has the id, or with ``whole`` all columns of ``docs``, and ``names``.  A document
    stays if it is more probably good than not and more probably not toxic than toxic.  Texts without
    words have no evidence and get their site's rate; null hosts and paths are sites of their own;
    without labels of both classes a head has no evidence either, and its site's rate is one half,
    which keeps a document.  Repeated rows count each.
    """
    classifier = train(docs, labels, id_col, text_col, sample_rows)
    heads = ("_quality", "_toxic")
    evidence = free_names(docs, "_e_quality", "_e_toxic")
    keys = free_names(docs, "_host", "_path")
    kept = list(docs.columns) if whole else [id_col]
    read = list(dict.fromkeys([*kept, text_col, host_col, path_col]))
    scored = with_evidence(docs.select(*[column(docs, c) for c in read]), text_col, classifier, evidence)
    # texts are scored once; what follows reads the written scores
    scored = settle(scored if whole else scored.drop(text_col), "evidence")

    def probability(e: str) -> Column:
        return 1 / (1 + F.exp(-F.col(e)))

    chances = scored.select(
        column(scored, host_col).alias("host"),
        column(scored, path_col).alias("path"),
        *[probability(e).alias(h) for e, h in zip(evidence, heads)],
    )
    rates, strengths = site_rates(chances, heads)
    sums = [c for c in rates.columns if c not in ("host", "path")]
    rate = {c: F.col(n) for c, n in zip(sums, free_names(scored, *["_rate_" + c for c in sums]))}
    renamed = rates.select(
        F.col("host").alias(keys[0]),
        F.col("path").alias(keys[1]),
        *[F.col(c).alias(n) for c, n in zip(sums, free_names(scored, *["_rate_" + c for c in sums]))],
    )
    joined = scored.join(
        renamed,
        column(scored, host_col).eqNullSafe(F.col(keys[0])) & column(scored, path_col).eqNullSafe(F.col(keys[1])),
    )
    posteriors = []
    for e, h in zip(evidence, heads):
        mean, host_strength, path_strength = strengths[h]
        own = probability(e)
        host = (rate[f"s_host_{h}"] - own + host_strength * mean) / (rate["n_host"] - 1 + host_strength)
        path = (rate[f"s_path_{h}"] - own + path_strength * host) / (rate["n_path"] - 1 + path_strength)
        posteriors.append(F.round(1 / (1 + F.exp(-(F.col(e) + _logit(path)))), 6))
    good, bad = posteriors
    return joined.select(
        *[column(joined, c) for c in kept],
        good.alias(names[0]),
        bad.alias(names[1]),
        ((good >= 0.5) & (bad <= 0.5)).alias(names[2]),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns."""
    names = tuple(free_names(docs, "_quality", "_toxic", "_keep"))
    judged = judge(docs, labels, names=names, whole=True, **options)
    return judged.filter(F.col(names[2])).select(*[column(judged, c) for c in docs.columns])
