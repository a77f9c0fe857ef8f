"""Plain Python versions of the spelling, resampling and piece operators."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from tests.llm.brute import FOLD


def word_counts(texts: list[tuple[int | None, str | None]]) -> dict[str, int]:
    counts: Counter = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            mark = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mark % 199 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes one of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def variants(counts: dict[str, int]) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n), over all pairs."""
    form: dict[str, str | None] = {}
    n_near = {}
    for word, n in counts.items():
        near = [o for o in counts if abs(len(o) - len(word)) < 2 and one_edit(o, word)]
        n_near[word] = len(near)
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (form[word], root, n, n_near[word], None if form[word] is None else counts[form[word]])
    return out


def feature_buckets(text: str | None, buckets: int = 10000) -> tuple[int, list[int]]:
    """(number of words, buckets of the runs of one to three words)."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [crc32(r.encode()) % buckets for r in runs]


def resampled(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> dict[int | None, tuple]:
    """doc_id -> (n_features, weight, score, rank)."""
    found = [(doc, *feature_buckets(text)) for doc, text in docs]
    source = Counter(b for _, _, buckets in found for b in buckets)
    wanted = Counter(b for text in target for b in feature_buckets(text)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [
        math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in range(10000)
    ]
    rows = []
    for doc, n_words, buckets in found:
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, n_words, len(buckets), weight, score))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {r: i + 1 for i, r in reversed(list(enumerate(fit[: 5 * len(fit) // 100])))}
    return {r[0]: (*r[2:], drawn.get(r)) for r in rows}
