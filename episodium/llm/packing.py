"""Best-fit-decreasing packing of token ids into fixed windows.

Each task tokenises its documents and packs them block by block, so nothing is shuffled and memory
is bounded by a block.  A document longer than a window is split losslessly: full windows stand
alone, its tail is packed with others.  Pieces are placed by decreasing length into the open window
with the least room that suffices, found in a segment tree over the capacities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodium.llm import tokens
from episodium.llm.common import column

WINDOW = 2048
#: Pieces are packed in blocks of at least so many ids.
BLOCK_IDS = 1 << 21

SCHEMA = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("token_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)
DDL = (
    "sequence_id long, n_tokens int, token_ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, starts array<long>"
)


class Capacities:
    """A segment tree over the capacities 0 .. window that finds the least non-empty one >= a length."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._change(capacity, 1)

    def pop(self, length: int) -> tuple[int, int] | None:
        """Take a bin of the least capacity of at least ``length``: (bin, capacity)."""
        node, count = self.leaves + length, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """The bins, each a list of indices into ``lengths``; every length is at most ``window``."""
    tree, bins = Capacities(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.pop(lengths[i])
        if found is None:
            bins.append([])
            found = len(bins) - 1, window
        number, room = found
        bins[number].append(i)
        tree.push(room - lengths[i], number)
    return bins


def _packed(pieces: list[tuple], window: int, pad_id: int, first: int) -> pa.RecordBatch:
    """Sequences of the pieces (doc_id, start, ids), numbered from ``first``."""
    bins = best_fit_decreasing([len(p[2]) for p in pieces], window)
    columns: list[list] = [[] for _ in SCHEMA]
    for number, members in enumerate(bins):
        chosen = [pieces[i] for i in members]
        ends = np.cumsum([len(p[2]) for p in chosen]).tolist()
        row = np.full(window, pad_id, "<u4")
        row[: ends[-1]] = np.concatenate([p[2] for p in chosen])
        values = (
            first + number,
            ends[-1],
            row.tobytes(),
            [0, *ends],
            [0, *ends[:-1]],
            [p[0] for p in chosen],
            [p[1] for p in chosen],
        )
        for held, value in zip(columns, values):
            held.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int | None = 1,
    pad_id: int = 0,
) -> DataFrame:
    """One row per sequence: its id matrix row and where its documents are.

    ``token_ids`` has ``window`` little-endian unsigned 32-bit ids, those after ``n_tokens`` being
    ``pad_id``; ``cu_seqlens`` are the cumulative segment lengths from 0; ``position_resets`` the
    offsets at which positions start again from 0; ``doc_ids`` and ``starts`` name each segment's
    document and how many of its ids come before.  Each id of each document is in one place.  Null
    and empty texts consist of the end id, or of nothing without one.  ``tokenizer`` is a byte-level
    BPE file.  Repeated rows are packed each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pieces, held = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = tokens.encode(texts.slice(at, 256).to_pylist(), tokenizer, end_id)
                for doc_id, found in zip(ids[at : at + 256], part):
                    for start in range(0, len(found), window):
                        pieces.append((doc_id, start, found[start : start + window]))
                    held += len(found)
                if held >= BLOCK_IDS:
                    out = _packed(pieces, window, pad_id, number)
                    number, pieces, held = number + out.num_rows, [], 0
                    yield out
        if pieces:
            yield _packed(pieces, window, pad_id, number)

    rows = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, DDL)


def write_packed(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet files, one matrix row with its lengths and resets to a record."""
    packed.write.parquet(path)
