"""Word and shingle hashes of many texts at once, computed with numpy on their UTF-8 bytes.

A word's hash depends on its folded bytes alone, a shingle's on the hashes of its words in order.
All arithmetic is modulo 2**64; equal inputs give equal hashes, and unequal ones differ but for a
chance of about 2**-64 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
#: Texts are hashed in blocks of about so many bytes, which bounds the memory of a task.
BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Powers of the base and of its inverse, as many as a block needs.
_held: dict[int, np.ndarray] = {}
#: What parts words: white space; or all of ASCII that is neither letter nor digit.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, factor = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * factor
        done += take
        factor = factor * factor
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """:func:`powers`, kept for the next block unless they are more than a few blocks need."""
    if n > 4 * BLOCK_BYTES:
        return powers(base, n)
    held = _held.get(int(base))
    if held is None or len(held) < n:
        held = _held[int(base)] = powers(base, max(n, BLOCK_BYTES + BLOCK_BYTES // 4))
    return held[:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers of ``x``, by one sort, which is quicker than hashing them."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def hash_words(
    texts: Sequence[str | None], parting: np.ndarray = BLANK, heads: Sequence[int] = ()
) -> tuple[np.ndarray, ...]:
    """(hashes of all words, offsets of each text's words); a null text has no words.

    For each number in ``heads`` there follow the hashes of the words' first so many bytes.
    """
    raw = [(t or "").encode() for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined.translate(_FOLD), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    gap = np.frombuffer(joined.translate(parting.tobytes()), bool)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edges = np.append(0, edges)
    starts, stops = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        value = data.astype(np.uint64)
        value += np.uint64(1)
        value *= _powers(_BASE, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        down = _powers(_INVERSE, len(data))

        def span(to: np.ndarray) -> np.ndarray:
            return mix((total[to] - total[starts]) * down[starts] + (to - starts).astype(np.uint64))

        words = span(stops)
        firsts = [span(np.minimum(starts + n, stops)) for n in heads]
    offsets = np.concatenate([[0], np.searchsorted(starts, ends)])
    return words, offsets, *firsts


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK_BYTES`` each, one text at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > BLOCK_BYTES:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``width`` words; fewer words are one run, none give none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            out = out * _STEP + words[i : n - width + 1 + i]
        return mix(out + np.uint64(width))


def block_shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` of each text's words, one after the other, and the offsets of each text's."""
    n = np.diff(offsets)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.append(0, np.cumsum(counts))
    with np.errstate(over="ignore"):
        runs = np.zeros(max(len(words) - SHINGLE + 1, 1), np.uint64)
        for i in range(min(SHINGLE, len(words))):
            runs *= _STEP
            runs += words[i : i + len(runs)]
        at = np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
        out = mix(runs[np.minimum(at, len(runs) - 1)] + np.uint64(SHINGLE))
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        out[bounds[i]] = shingles(words[offsets[i] : offsets[i + 1]])[0]
    return out, bounds


def block_sets(texts: Sequence[str | None], parting: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one set after the other, and the sets' offsets."""
    found, bounds = block_shingles(*hash_words(texts, parting))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < len(found)]] = True
    return found[new], np.append(0, np.cumsum(new))[bounds]


def shingle_sets(texts: Sequence[str | None], parting: np.ndarray = BLANK) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last in blocks(texts):
        found, bounds = block_sets(texts[first:last], parting)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield found[a:b]
