"""The classifier's features: counted over blocks of texts, told apart by sorting."""

import numpy as np

from episodium.llm import quality, words

TEXTS = [None, "", "A | b!! a", "one two One\n#tag {x} éa", "!!! ???", "word " * 40]


def test_features_are_told_apart_without_hashing(monkeypatch):
    unique, calls = np.unique, []
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    assert len(list(quality.features(TEXTS * 50))) == 300 and not calls


def test_features_are_those_of_each_text_alone():
    together = list(quality.features(TEXTS))
    for text, found in zip(TEXTS, together, strict=True):
        (alone,) = quality.features([text])
        assert found.tolist() == alone.tolist()
        shape = found[-7:] - quality.WORD_BUCKETS - np.arange(7) * quality.SHAPE_BINS
        letters = [c for c in text or "" if c.isascii() and c.isalpha()]
        hashed, _ = words.hash_words([text], words.PUNCTUATION)
        n = len(hashed)
        upper = sum(c.isupper() for c in letters) / max(len(letters), 1)
        assert shape[0] == (0 if upper == 0 else int(np.clip(15 + np.floor(np.log2(upper)), 1, 15)))
        assert shape[4] == min(len(set(hashed.tolist())) * 15 // max(n, 1), 15)
        assert shape[6] == min(len(letters) // max(n, 1), 15)
        buckets = found[:-7]
        assert (np.diff(buckets) > 0).all() and len(buckets) <= (1 + len(quality.HEADS)) * n and {int(h % np.uint64(quality.WORD_BUCKETS)) for h in hashed} <= set(buckets.tolist())
