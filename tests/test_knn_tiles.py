"""Scores of a group are compared in tiles that fit a core's cache; what fills the last tile up is never found."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from ragspark.operators import retrieval


def unit(rng, n, dims=8):
    m = rng.normal(size=(n, dims))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def best(q, c, k, exclude_self):
    return pd.concat(retrieval._best_of_group(np.arange(len(q)), q, np.arange(len(c)), c, k, exclude_self))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1023, 1025, 9001])
@pytest.mark.parametrize("below", [False, True])
def test_any_number_of_chunks(n, below):
    rng = np.random.default_rng(n)
    q, c = unit(rng, 30), unit(rng, n)
    if below:  # all cosines negative: a row of zeros would win
        q, c = np.abs(q), -np.abs(c)
    for exclude_self in (False, True):
        points = np.rint(q @ c.T * 10**6)
        if exclude_self:
            points[np.arange(min(30, n)), np.arange(min(30, n))] = np.nan
        want = [(i, j, points[i, j] / 10**6) for i in range(30) for j in [j for j in np.lexsort((np.arange(n), -points[i])) if points[i, j] == points[i, j]][:4]]
        assert sorted(best(q, c, 4, exclude_self).itertuples(index=False, name=None)) == sorted(want)


def test_scores_of_a_tile_fit_the_cache():
    rng = np.random.default_rng(5)
    q, c = unit(rng, 600), unit(rng, 16384)
    tracemalloc.start()
    best(q, c, 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak)
    assert peak < 8 << 20
