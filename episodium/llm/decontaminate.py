"""Benchmark passages in documents, found by SimHash over windows of an item's size.

Every window of a document that has as many words as an item and shares a shingle with an item of
that size is fingerprinted: each shingle votes, with its multiplicity, on 64 bits.  A multi-index
over eight blocks of eight bits finds all items within the radius: of two fingerprints that differ in
at most 27 bits, one block differs in at most three, so each block's byte is looked up among all
bytes within three flips.  The candidates are verified by the exact weighted Jaccard similarity of
their shingles.  (A window without a common shingle has similarity 0 and needs no fingerprint.)

Words are runs of letters and digits with A-Z in lower case, so punctuation and layout do not hide a
passage.  Documents are read once and not shuffled; the items are held in each task, in blocks of a
fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodium.llm import words
from episodium.llm.common import column

THRESHOLD = 0.75
RADIUS, BLOCKS = 27, 8
#: Items held in a task at a time; more items take more passes over the documents.
ITEM_BLOCK = 10_000
_BITS = np.arange(64, dtype=np.uint64)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles: a bit is set if more than half have it set."""
    votes = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32), axis=0, out=votes[1:])
    ayes = votes[width:] - votes[:-width]
    return ((2 * ayes > width).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def bytes_of(codes: np.ndarray) -> np.ndarray:
    return codes.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle sequences, a shingle weighing its multiplicity."""
    keys, counts = np.unique(a, return_counts=True)
    others, weights = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(keys, others, assume_unique=True, return_indices=True)
    both = int(np.minimum(counts[i], weights[j]).sum())
    return both / (len(a) + len(b) - both)


class ItemIndex:
    """Items by size, with their shingles, fingerprints and multi-index tables."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str | None]) -> None:
        found, offsets = words.hash_words(texts, words.PUNCTUATION)
        kept = [(i, found[a:b]) for i, a, b in zip(ids, offsets[:-1], offsets[1:]) if b > a]
        self.sizes: dict[int, tuple] = {}
        lookup: list[tuple[int, int]] = []
        for size in sorted({len(w) for _, w in kept}):
            members = [(i, words.shingles(w)) for i, w in kept if len(w) == size]
            codes = np.concatenate([fingerprints(s, len(s)) for _, s in members])
            near = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
            table = np.stack([near[:, bytes_of(codes)[:, b]] for b in range(BLOCKS)])
            self.sizes[size] = (members, codes, table)
            lookup += [(int(h), size) for _, s in members for h in np.unique(s)]
        pairs = np.unique(np.array(lookup, np.uint64).reshape(-1, 2), axis=0)
        self.hashes, first = np.unique(pairs[:, 0], return_index=True)
        self.bounds = np.append(first, len(pairs))
        self.size_of = pairs[:, 1].astype(np.int64)
        self.widths = sorted({min(words.SHINGLE, size) for size in self.sizes})
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def shared(self, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size, the positions of shingles that an item of that size has."""
        places = np.flatnonzero(self.filter[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(places):
            return {}
        at = np.minimum(np.searchsorted(self.hashes, shingles[places]), len(self.hashes) - 1)
        true = self.hashes[at] == shingles[places]
        places, at = places[true], at[true]
        counts = self.bounds[at + 1] - self.bounds[at]
        if not counts.sum():
            return {}
        rows = np.repeat(places, counts)
        index = np.concatenate([np.arange(a, b) for a, b in zip(self.bounds[at], self.bounds[at + 1])])
        sizes = self.size_of[index]
        return {int(s): np.unique(rows[sizes == s]) for s in np.unique(sizes)}

    def matches(self, doc: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window for each item that matches."""
        best: dict[int, tuple[float, int, int]] = {}
        by_width = {w: words.shingles(doc, w) for w in self.widths if len(doc)}
        shared = {w: self.shared(s) for w, s in by_width.items()}
        for width in self.widths if len(doc) else []:
            for size, hits in shared[width].items():
                if min(words.SHINGLE, size) != width:
                    continue
                shingles = by_width[width]
                members, codes, table = self.sizes[size]
                span = min(size - width + 1, len(shingles))
                cover = np.zeros(len(shingles) + 1, np.int64)
                np.add.at(cover, np.maximum(hits - span + 1, 0), 1)
                np.add.at(cover, hits + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover[:-1])[: len(shingles) - span + 1])
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for at in range(0, len(run), 4096):
                        self._verify(shingles, run[at : at + 4096], span, width, members, codes, table, best)
        return [(i, s, a, n) for i, (s, a, n) in best.items()]

    @staticmethod
    def _verify(shingles, starts, span, width, members, codes, table, best) -> None:
        first = int(starts[0])
        found = fingerprints(shingles[first : int(starts[-1]) + span], span)
        parts = bytes_of(found)
        likely = table[0][parts[:, 0]]
        for b in range(1, BLOCKS):
            likely = likely | table[b][parts[:, b]]
        rows, items = np.nonzero(likely)
        far = _ONES[bytes_of(found[rows] ^ codes[items])].sum(axis=1)
        for row, item in zip(rows[far <= RADIUS].tolist(), items[far <= RADIUS].tolist()):
            item_id, wanted = members[item]
            start = first + row
            value = similarity(shingles[start : start + span], wanted)
            if value >= THRESHOLD and value > best.get(item_id, (0.0,))[0]:
                best[item_id] = (value, start, span + width - 1)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[ItemIndex]:
    """Indexes of ``ITEM_BLOCK`` items each, in the order of their ids; null ids are no items."""
    rows = items.select(column(items, id_col).cast("long").alias("id"), column(items, text_col).alias("text"))
    rows = rows.filter("id is not null").orderBy("id", "text")
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == ITEM_BLOCK:
            yield ItemIndex([r["id"] for r in held], [r["text"] for r in held])
            held = []
    if held:
        yield ItemIndex([r["id"] for r in held], [r["text"] for r in held])


def _matches(texts: Sequence[str | None], index: ItemIndex) -> Iterator[list]:
    for first, last in words.blocks(texts):
        found, offsets = words.hash_words(texts[first:last], words.PUNCTUATION)
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield index.matches(found[a:b])


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for each document and item that match.

    A document matches an item if a window of the item's size, or all of a shorter document, has a
    weighted shingle similarity of at least ``THRESHOLD``; the window given is the first of the most
    similar ones.  Null and empty texts match nothing; items without words neither.  Repeated rows
    are reported each.  Items that repeat an id count as further texts of it.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    ddl = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("item_id", pa.int64()),
            ("similarity", pa.float64()),
            ("first_word", pa.int64()),
            ("n_words", pa.int64()),
        ]
    )

    def finder(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    (doc_id, item, round(value, 6), start, n)
                    for doc_id, found in zip(
                        batch.column(0).to_pylist(), _matches(batch.column(1).to_pylist(), index)
                    )
                    for item, value, start, n in found
                ]
                columns = zip(*out) if out else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

        return run

    parts = [rows.mapInArrow(finder(index), ddl) for index in item_blocks(items)]
    if not parts:
        return rows.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in [x.split() for x in ddl.split(", ")[1:]]])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item, whole."""
    at = docs.columns.index(text_col)

    def keeper(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not found for found in _matches(batch.column(at).to_pylist(), index)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for index in item_blocks(items):
        docs = docs.mapInArrow(keeper(index), docs.schema)
    return docs
