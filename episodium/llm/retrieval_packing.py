"""Packing by lexical retrieval: a window is filled with the neighbours of its seed document.

Terms are token ids, so the statistics of the whole corpus (document frequencies, mean length) are a
table of at most the vocabulary's size.  Documents are dealt to shards by their two most telling
terms; terms that many documents hold are salted by a hash of the document, so that shards stay even
when one pair of terms leads a third of all.  A task streams its shard in blocks, holds a BM25
inverted index of a block and fills window after window: the seed's unused neighbours in order of
their score, the last one cut where the window ends; what is left of it seeds the next.  Only the
last window of a shard can be short.  Documents longer than a window fill windows of their own with
their first ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodium.llm import tokens
from episodium.llm.common import column
from episodium.workspace import settle

WINDOW = 2048
K1, B = 1.2, 0.75
QUERY_TERMS = 24
#: Documents that lead with the same terms are dealt in groups of about so many.
GROUP_DOCS = 512
#: Ids in a shard, on average, and in a block of it, at most (one document at least).
SHARD_IDS, BLOCK_IDS = 1 << 22, 1 << 20

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids) with the ids as little-endian unsigned 32-bit numbers, or 16-bit if all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = tokens.encode(part.column(1).to_pylist(), tokenizer, end_id)
                wide = max(end_id, tokens.encoder(tokenizer).max_token_value) >= 1 << 16
                ids = [x.astype("<u4" if wide else "<u2").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) for x in found], pa.int64())],
                    ["doc_id", "ids", "doc_tokens"],
                )

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, doc_tokens long")


def _ids(cell: pa.BinaryScalar, n: int) -> np.ndarray:
    data = cell.as_buffer()
    return np.frombuffer(data, "<u4" if data.size == 4 * n else "<u2")


def _tails(batch: pa.RecordBatch, window: int) -> Iterator[tuple]:
    """(doc_id, doc_tokens, start, ids) of what whole windows leave of each document."""
    for doc_id, cell, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
        start = n - n % window
        if start < n:
            yield doc_id, n, start, _ids(cell, n)[start:]


def whole_windows(table: DataFrame, window: int) -> DataFrame:
    """The pieces that fill a window alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 40) + 1
        for batch in batches:
            rows = []
            for doc_id, cell, n in zip(*[batch.column(i) for i in range(2)], batch.column(2).to_pylist()):
                ids = _ids(cell, n)
                for start in range(0, n - window + 1, window):
                    rows.append((doc_id.as_py(), start, window, _crc(ids[start : start + window]), n, -number, 0))
                    number += 1
            yield _batch(rows, PIECES)

    return table.filter(F.col("doc_tokens") >= window).mapInArrow(run, DDL)


def term_statistics(table: DataFrame, window: int) -> tuple[np.ndarray, int, int]:
    """(documents that hold each term, number of documents, number of ids), of the tails to pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, length = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for _, _, _, ids in _tails(batch, window):
                if ids.max() >= len(seen):
                    seen = np.concatenate([seen, np.zeros(int(ids.max()) * 2 - len(seen), np.int64)])
                seen[np.unique(ids)] += 1
                docs, length = docs + 1, length + len(ids)
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-2, -1, *terms.tolist()], pa.int64()),
                pa.array([docs, length, *seen[terms].tolist()], pa.int64()),
            ],
            ["term", "n"],
        )

    rows = table.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.toLocalIterator()}
    docs, length = found.pop(-2, 0), found.pop(-1, 0)
    frequency = np.zeros(max(found, default=0) + 1, np.int64)
    frequency[list(found)] = list(found.values())
    return frequency, docs, length


def inverse_frequency(frequency: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)


class Index:
    """BM25 inverted index of a block: postings of each term, with the term's weight in a document."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.idf, self.n = idf, len(docs)
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(self.n), lengths)
        keys, counts = np.unique(np.concatenate(docs).astype(np.int64) * self.n + owner, return_counts=True)
        terms, self.posting = keys // self.n, (keys % self.n).astype(np.int32)
        norm = K1 * (1 - B + B * lengths[self.posting] / mean)
        self.weight = idf[terms] * counts * (K1 + 1) / (counts + norm)
        self.terms, starts = np.unique(terms, return_index=True)
        self.bounds = np.append(starts, len(terms))
        self.used = np.zeros(self.n, bool)

    def neighbours(self, query: np.ndarray) -> np.ndarray:
        """Unused documents that share a leading term of the query, the best first."""
        terms, counts = np.unique(query, return_counts=True)
        if len(terms) > QUERY_TERMS:
            best = np.argpartition(-self.idf[terms] * counts / (counts + K1), QUERY_TERMS)[:QUERY_TERMS]
            terms, counts = terms[best], counts[best]
        places = np.searchsorted(self.terms, terms)
        spans = [
            (self.bounds[p], self.bounds[p + 1])
            for p, t in zip(places.tolist(), terms.tolist())
            if p < len(self.terms) and self.terms[p] == t
        ]
        if not spans:
            return np.empty(0, np.int64)
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        score = np.bincount(self.posting[at], self.weight[at], self.n)
        score[self.used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Filler:
    """Fills the windows of one shard."""

    def __init__(self, window: int, number: int) -> None:
        self.window, self.number, self.fill = window, number, 0
        self.rows: list[tuple] = []
        self.seed: np.ndarray | None = None

    def add(self, doc: tuple) -> bool:
        """Put a document at the end of the window; True if that ends the window.

        What does not fit starts the next window and is its seed.
        """
        doc_id, doc_tokens, start, ids = doc
        closed = False
        while len(ids):
            part = ids[: self.window - self.fill]
            if not self.fill:
                self.seed = ids
            self.rows.append((doc_id, start, len(part), _crc(part), doc_tokens, self.number, self.fill))
            self.fill, start, ids = self.fill + len(part), start + len(part), ids[len(part) :]
            if self.fill == self.window:
                self.number, self.fill, closed = self.number + 1, 0, True
        return closed

    def block(self, docs: list[tuple], idf: np.ndarray, mean: float) -> None:
        index = Index([d[3] for d in docs], idf, mean)
        longest = iter(np.argsort([-len(d[3]) for d in docs], kind="stable").tolist())
        left = len(docs)
        while left:
            if not self.fill:
                first = next(i for i in longest if not index.used[i])
                index.used[first] = True
                left -= 1
                self.add(docs[first])
                continue
            found = index.neighbours(self.seed)
            if not len(found):
                first = next(i for i in longest if not index.used[i])
                found = [first]
            for i in found:
                index.used[i] = True
                left -= 1
                if self.add(docs[i]):
                    break


def pack_by_retrieval(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids followed by ``end_id``; a null text is empty and has that id alone.  Each
    id is in one piece; the pieces of a sequence lie next to each other from offset 0.  A shard ends
    with at most one sequence shorter than ``window``.  Repeated rows are packed each, also under one
    id; an empty table gives no pieces; other columns are not read.
    """
    table = settle(token_table(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    frequency, n_docs, n_ids = term_statistics(table, window)
    idf = inverse_frequency(frequency, n_docs)
    mean = n_ids / max(1, n_docs)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, start, ids in _tails(batch, window):
                terms, counts = np.unique(ids, return_counts=True)
                weight = idf[terms] * counts / (counts + K1)
                first = terms[np.argsort(-weight, kind="stable")[:2]]
                data = ids.astype("<u2" if frequency.size <= 1 << 16 else "<u4").tobytes()
                groups = int(frequency[first].min()) // GROUP_DOCS + 1
                salt = zlib.crc32(f"{doc_id} {zlib.crc32(data)}".encode()) % groups
                rows.append((doc_id, n, start, data, int(first[0]), int(first[-1]), salt))
            yield _batch(rows, keyed_schema)

    keyed_schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("doc_tokens", pa.int64()),
            ("start", pa.int64()),
            ("ids", pa.binary()),
            ("lead", pa.int64()),
            ("next", pa.int64()),
            ("salt", pa.int64()),
        ]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(window, TaskContext.get().partitionId() << 40)
        held, size = [], 0
        for batch in batches:
            for doc_id, n, start, cell in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                ids = _ids(cell, n - start)
                if held and size + len(ids) > BLOCK_IDS:
                    filler.block(held, idf, mean)
                    yield _batch(filler.rows, PIECES)
                    held, size, filler.rows = [], 0, []
                held.append((doc_id, n, start, ids))
                size += len(ids)
        if held:
            filler.block(held, idf, mean)
        yield _batch(filler.rows, PIECES)

    shards = max(1, -(-n_ids // SHARD_IDS))
    tails = (
        table.mapInArrow(
            keyed, "doc_id long, doc_tokens long, start long, ids binary, lead long, next long, salt long"
        )
        .repartition(shards, "lead", "next", "salt")
        .sortWithinPartitions("lead", "next")
        .select("doc_id", "doc_tokens", "start", "ids")
    )
    return whole_windows(table, window).unionByName(tails.mapInArrow(fill, DDL))
