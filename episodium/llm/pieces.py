"""SentencePiece ids by a table of distinct marked words, and texts from ids.

When no piece has a blank's mark after another character, no piece crosses the start of a marked
word (blanks with what follows up to the next blank).  Nor does one cross two characters that no
piece has side by side, so a marked word is cut there into parts.  Each distinct part is segmented
once, and a text's ids are those of its parts in order.

Texts are cut in blocks of bounded size.  A block numbers its own distinct parts; its part table
(part, place) is shuffled by part and sorted, so that equal parts of all blocks stand together and
are segmented once; the ids go back to the blocks, where each document's part numbers pick them by
position.  What is shuffled is one row per distinct part of a block, and the documents' numbers,
compressed; a part has one place per block, however frequent it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodium.llm.common import column, free_names

MARK = "▁"
#: A character in no piece; nothing merges with it, so what follows is segmented on its own.
GUARD = "\n"
#: Texts are cut in blocks of so many characters; a longer text is a block of its own.
BLOCK_CHARS = 1 << 25
#: Part numbers are compressed and joined in runs of about so many words.
RUN_WORDS = 1 << 18
#: A place is a block's number (partition and count) and a part's number within the block.
BLOCK_BITS, PART_BITS = 10, 30

_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_SUM = 0x7FFFFFFFFFFFFFFF


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Model:
    """A SentencePiece model whose pieces do not cross the start of a marked word."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        special = [self.processor.is_control(i) or self.processor.is_byte(i) for i in range(size)]
        pieces = [self.processor.id_to_piece(i) for i in range(size) if not special[i]]
        if any(GUARD in p or MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path} has pieces that cross the start of a marked word")
        if self.processor.normalize(" ﬁ  x ") != MARK.join(["", "", "ﬁ", "", "x", ""]):
            raise ValueError(f"{path} changes texts before it cuts them")
        self.guard_ids = len(self.processor.encode(GUARD))
        # characters that are next to others in pieces, and which of them are next to which
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        known = sorted({ord(c) for pair in pairs for c in pair})
        self._class = np.zeros(0x110000, np.uint16)
        self._class[known] = np.arange(1, len(known) + 1)
        self._next = np.zeros((len(known) + 1, len(known) + 1), bool)
        for one, two in pairs:
            self._next[self._class[ord(one)], self._class[ord(two)]] = True

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words of a text, in order, each without its first mark."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " ":
            return [word[1:] for word in _WORDS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(parts of all words, number of parts of each word), words being without their first mark."""
        joined = MARK + MARK.join(words)
        kinds = self._class[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        cut = ~self._next[kinds[:-1], kinds[1:]]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cut[ends[:-1] - 1] = True
        edges = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(kinds)]])
        counts = np.diff(np.searchsorted(edges, ends), prepend=0)
        places = edges.tolist()
        return [joined[a:b] for a, b in zip(places, places[1:])], counts

    def segment(self, parts: list[str]) -> list[list[int]]:
        """The ids of each part."""
        found = self.processor.encode([GUARD + p for p in parts], num_threads=1)
        return [ids[self.guard_ids :] for ids in found]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The model of a file, made once in a worker."""
    return Model(path)


def picked(which: np.ndarray, sizes: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that ``which`` names, one after the other; run i ends at ``ends[i]``."""
    held = sizes[which]
    starts = np.repeat(ends[which] - np.cumsum(held), held)
    return flat[starts + np.arange(len(starts))]


def checksum(parts: list[str], numbers: np.ndarray) -> int:
    """A sum over parts and their numbers, in any order."""
    return int((_marks(parts) * (2 * numbers.astype(np.uint64) + np.uint64(1))).sum()) & _SUM


def _marks(parts: list[str]) -> np.ndarray:
    return np.fromiter((crc32(p.encode()) for p in parts), np.uint64, len(parts))


class _Block:
    """The documents of a block, as numbers of its words."""

    def __init__(self, number: int) -> None:
        self.number, self.held = number, 0
        self.words, self.docs, self.numbers = Numbers(), [], []

    def add(self, doc: int | None, text: str) -> None:
        words = Model.words(text)
        self.docs.append(doc)
        self.numbers.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.held += len(text)

    def cut(self, model_: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct parts, part numbers of all words, number of parts of each word)."""
        if not self.words:
            return [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts, counts = model_.parts(list(self.words))
        numbers = Numbers()
        flat = np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts))
        return list(numbers), flat, counts


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[_Block]:
    first = TaskContext.get().partitionId() << BLOCK_BITS
    block = _Block(first)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if block.held and block.held + len(text) > block_chars:
                yield block
                block = _Block(block.number + 1)
                if block.number == first + (1 << BLOCK_BITS):
                    raise ValueError("one partition of docs holds too much text; repartition it")
            block.add(doc, text)
    if block.docs:
        yield block


def _part_table(path: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            parts, first = block.cut(model(path))[0], block.number << PART_BITS
            for at in range(0, len(parts), 1 << 16):
                some = parts[at : at + (1 << 16)]
                places = np.arange(first + at, first + at + len(some), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(places)], names=["part", "place"])

    return run


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by the planes of their bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


_NUMBERS = pa.schema(
    [
        ("block", pa.int64()), ("check", pa.int64()), ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())), ("numbers", pa.binary()),
    ]
)


def _number_table(path: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            parts, flat, counts = block.cut(model(path))
            check, ends = checksum(parts, np.arange(len(parts))), np.cumsum(counts)
            del parts
            at = 0
            while at < len(block.docs):
                last, words = at, 0
                while last < len(block.docs) and (last == at or words + len(block.numbers[last]) <= RUN_WORDS):
                    words += len(block.numbers[last])
                    last += 1
                chosen = block.numbers[at:last]
                sizes = [int(counts[n].sum()) for n in chosen]
                numbers = picked(np.concatenate(chosen), counts, ends, flat)
                row = [[block.number], [check], [block.docs[at:last]], [sizes], [_packed(numbers)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _NUMBERS)], schema=_NUMBERS)
                at = last

    return run


_SEGMENTED = pa.schema(
    [("block", pa.int64()), ("check", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]
)


def _narrow(values: np.ndarray) -> bytes:
    """Small numbers as bytes, in 16 bits each if they fit, else in 32."""
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4").tobytes()


def _wide(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * size else "<u4")


def _segmented(path: str):
    """Sorted (part, place) rows to the ids of a block's parts, each distinct part segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, last_ids = model(path), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0), run_end_type=pa.int32())
            parts = runs.values.to_pylist()
            known = parts[0] == last
            found = [last_ids] * known + cut.segment(parts[1:] if known else parts)
            last, last_ids = parts[-1], found[-1]
            of_row = np.repeat(np.arange(len(parts)), np.diff(np.array(runs.run_ends), prepend=0))
            places = batch.column(1).to_numpy()
            blocks, numbers = places >> PART_BITS, places & ((1 << PART_BITS) - 1)
            checks = _marks(parts)[of_row] * (2 * numbers.astype(np.uint64) + np.uint64(1))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
            ends = np.cumsum(sizes)
            order = np.argsort(blocks, kind="stable")
            columns: list[list] = [[] for _ in _SEGMENTED]
            for rows in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
                of = of_row[rows]
                values = (
                    int(blocks[rows[0]]),
                    int(checks[rows].sum()) & _SUM,
                    numbers[rows].astype("<u4").tobytes(),
                    _narrow(sizes[of]),
                    _narrow(picked(of, sizes, ends, flat)),
                )
                for held, value in zip(columns, values):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTED)], schema=_SEGMENTED)

    return run


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of a block's documents: ``left`` has their part numbers, ``right`` the parts' ids."""
    check = sum(right.column("check").to_pylist()) & _SUM
    if set(left.column("check").to_pylist()) != {check}:
        raise RuntimeError("the rows of docs came in another order when they were read again; write them first")
    n = sum(map(len, right.column("numbers").to_pylist())) // 4
    size_of, end_of, ids, held = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
    for numbers, counts, found in zip(*(right.column(c).to_pylist() for c in ("numbers", "sizes", "ids"))):
        numbers = np.frombuffer(numbers, "<u4")
        size_of[numbers] = sizes = _wide(counts, len(numbers)).astype(np.int64)
        end_of[numbers] = held + np.cumsum(sizes)
        held += int(sizes.sum())
        ids.append(_wide(found, int(sizes.sum())).astype(np.int32))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    batches = []
    for docs, counts, packed in zip(*(left.column(c).to_pylist() for c in ("docs", "sizes", "numbers"))):
        parts = _unpacked(packed, sum(counts))
        lengths = np.concatenate([[0], np.cumsum(size_of[parts])])
        offsets = lengths[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(picked(parts, size_of, end_of, flat)))
        batches.append(pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], schema=_ENCODED))
    return pa.Table.from_batches(batches, schema=_ENCODED)


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, ids array<int>) for every row: the ids that the model of the file gives its text.

    They are those of the library's ``encode`` without begin and end ids.  Null and empty texts have
    none.  Repeated rows are encoded each; other columns are not read.  The model must not change
    texts before it cuts them, and its pieces must not cross blanks.

    ``docs`` is read twice and must give its rows in the same order each time, as files and written
    tables do; else the job fails with a message, it does not mix up ids.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc"), column(docs, text_col).alias("text"))
    parts = rows.mapInArrow(_part_table(path, block_chars), "part string, place long")
    segmented = (
        parts.repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_segmented(path), "block long, check long, numbers binary, sizes binary, ids binary")
    )
    numbers = rows.mapInArrow(
        _number_table(path, block_chars), "block long, check long, docs array<long>, sizes array<long>, numbers binary"
    )

    return (
        numbers.groupBy("block").cogroup(segmented.groupBy("block")).applyInArrow(_joined, "doc_id long, ids array<int>")
    )


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as one more column, by the library's ``decode``.

    Null and empty lists give an empty text.  ``name`` is changed if ``encoded`` has such a column.
    """
    (name,) = free_names(encoded, name)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = model(path).processor
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = part.column(at).flatten().to_numpy().tolist()
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part.column(at)), 0)).tolist()
                spans = zip([0, *ends], ends)
                texts = [processor.decode(ids[a:b]) if a < b else "" for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name]
                )

    schema = encoded.select("*", F.lit("").alias(name)).schema
    return encoded.mapInArrow(run, schema)
