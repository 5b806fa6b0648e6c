"""What op12's driver holds while it fits its tree."""

import tracemalloc

import numpy as np

from wayspark.llm import hard_negatives as H


def test_fit_holds_little_more_than_its_sample():
    sample = np.random.default_rng(1).integers(-300, 300, (16384, 64)).astype(float)
    top = float((sample * sample).sum(1).max())
    tracemalloc.start()
    tree = H.fit(sample, top, 64, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the squares of what eight pivots were apart from all rows took sixteen times the sample
    assert peak < 4 * sample.nbytes
    leaves = np.bincount(tree.route(sample)[0], minlength=1024)
    assert leaves.min() > 0 and leaves.max() <= 64
