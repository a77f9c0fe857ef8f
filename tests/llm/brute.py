"""Plain Python versions of what the text operators must return."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None) -> frozenset:
    found = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]
    if not found:
        return frozenset()
    width = min(5, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """id -> (size of the shingle set, least id reachable by links), over all pairs."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    lead = {k: k for k in sets}

    def find(k: int) -> int:
        while lead[k] != k:
            k = lead[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                one, two = sorted((find(a), find(b)))
                lead[two] = one
    return {k: (len(sets[k]), find(k)) for k in ids}


def passage_words(text: str | None) -> list[str]:
    return [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", (text or "").translate(FOLD)) if w]


def runs(found: list[str]) -> list[tuple]:
    width = min(5, len(found))
    return [tuple(found[i : i + width]) for i in range(len(found) - width + 1)] if found else []


def passages(texts: dict[int, str | None], items: dict[int, str | None]) -> dict[tuple[int, int], tuple[float, int]]:
    """(doc, item) -> (similarity, first word) of the best window of the item's size."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for doc, text in texts.items():
        found = passage_words(text)
        for item, wanted in items.items():
            size = len(passage_words(wanted))
            need = Counter(runs(passage_words(wanted)))
            if not need or not found:
                continue
            for start in range(max(1, len(found) - size + 1)):
                window = found[start : start + size]
                have = Counter(runs(window)) if min(5, len(window)) == min(5, size) else Counter()
                both = sum((have & need).values())
                value = both / (have.total() + need.total() - both)
                if value >= 0.75 and value > best.get((doc, item), (0.0, 0))[0]:
                    best[doc, item] = (value, start)
    return best


def card_is_valid(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = int(char) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def feistel_string(value: str, key: str, kind: str, classes: list[str]) -> str:
    """A value permuted within its format, half by half."""

    def turned(part: str, other: str, turn: int) -> str:
        digest = hashlib.sha512(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest()
        out = []
        for i, char in enumerate(part):
            by = int(digest[i % 32 * 4 : i % 32 * 4 + 4], 16)
            letters = next((c for c in classes if char in c), None)
            out.append(char if letters is None else letters[(letters.index(char) + by) % len(letters)])
        return "".join(out)

    one, two = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(8):
        if turn % 2 == 0:
            one = turned(one, two, turn)
        else:
            two = turned(two, one, turn)
    return one + two


def feistel_number(value: int, key: str, kind: str, a: int, b: int) -> int:
    """A number of 0 .. a * b - 1 permuted within that domain."""
    one, two = divmod(value, b)
    for turn in range(8):
        by = int(hashlib.sha512(f"{key}|{kind}|{turn}|{two if turn % 2 == 0 else one}".encode()).hexdigest()[:12], 16)
        if turn % 2 == 0:
            one = (one + by) % a
        else:
            two = (two + by) % b
    return one * b + two


def posteriors(rows: list[tuple], heads: int = 2) -> list[list[float]]:
    """Posterior probabilities of rows (host, path, evidence of each head), all documents seen at once."""
    out = []
    for head in range(heads):
        own = [1 / (1 + math.exp(-r[2 + head])) for r in rows]
        hosts, paths = {}, {}
        for r, p in zip(rows, own):
            hosts.setdefault(r[0], []).append(p)
            paths.setdefault(r[:2], []).append(p)
        n, mean = len(rows), sum(own) / len(rows)

        def average(values: list[float]) -> float:
            return sum(values) / len(values)

        def strength(spread: float, groups: int) -> float:
            chance = mean * (1 - mean)
            beyond = spread / n - chance * groups / n
            return 10_000.0 if beyond <= 0 or chance <= 0 else min(max(chance / beyond - 1, 1.0), 10_000.0)

        by_host = strength(sum(len(v) * (average(v) - mean) ** 2 for v in hosts.values()), len(hosts))
        by_path = strength(sum(len(v) * (average(v) - average(hosts[k[0]])) ** 2 for k, v in paths.items()), len(paths))
        found = []
        for r, p in zip(rows, own):
            host = (sum(hosts[r[0]]) - p + by_host * mean) / (len(hosts[r[0]]) - 1 + by_host)
            path = (sum(paths[r[:2]]) - p + by_path * host) / (len(paths[r[:2]]) - 1 + by_path)
            path = min(max(path, 1e-4), 1 - 1e-4)
            found.append(1 / (1 + math.exp(-(r[2 + head] + math.log(path / (1 - path))))))
        out.append(found)
    return [list(x) for x in zip(*out)]
