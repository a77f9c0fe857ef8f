"""Features are counted a block of rows at a time, so the driver holds no second copy of the sample."""

import tracemalloc

import numpy as np

from episodium.llm import quality


def test_counts_by_blocks():
    draw = np.random.default_rng(7)
    rows = [np.unique(draw.integers(0, quality.FEATURES, 1200)).astype(np.int32) for _ in range(2000)]
    whole = np.bincount(np.concatenate(rows), minlength=quality.FEATURES)
    labels = (np.arange(len(rows)) % 3 == 0).astype(float)
    tracemalloc.start()
    assert (quality._counts(rows) == whole).all()
    quality.fit(rows, labels, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the 2.4 million features take 19 MB as 64-bit numbers; fit() used to make several such arrays
    assert peak < 19e6
