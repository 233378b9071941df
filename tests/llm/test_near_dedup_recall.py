"""Pairs of sets at the limit, through the samples, bands and sketches that the operator uses."""

import math

import numpy as np
import pytest
from tessera.llm import near_dedup


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [40, 300])
def test_pairs_at_the_limit_are_found(percent, size):
    rng = np.random.default_rng(percent * size)
    rows, most = near_dedup.band_rows(percent), near_dedup._bits_at(percent / 100)
    both = math.ceil(2 * size * percent / (100 + percent))
    agreeing, estimates, pairs = [], [], 1000
    for _ in range(pairs):
        hashes = rng.integers(0, 1 << 64, 2 * size - both, dtype=np.uint64)
        a, b = np.sort(hashes[:size]), np.sort(hashes[size - both :])
        assert near_dedup.linked(a, b, percent)
        x, y = near_dedup.samples(a), near_dedup.samples(b)
        differing = int(np.bitwise_count(near_dedup.odd_sketch(x) ^ near_dedup.odd_sketch(y)).sum())
        assert (near_dedup.band_keys(x, rows) == near_dedup.band_keys(y, rows)).any() and differing <= most
        agreeing.append((x == y).mean())
        estimates.append(near_dedup.similarity(differing))
    similar = both / (2 * size - both)
    assert abs(np.mean(agreeing) - similar) < 0.005 and abs(np.mean(estimates) - similar) < 0.01


def test_pairs_far_below_the_limit_are_left(percent=85, size=300):
    rng = np.random.default_rng(5)
    both = size // 2  # similarity of a third
    for _ in range(300):
        hashes = rng.integers(0, 1 << 64, 2 * size - both, dtype=np.uint64)
        x, y = near_dedup.samples(hashes[:size]), near_dedup.samples(hashes[size - both :])
        assert int(np.bitwise_count(near_dedup.odd_sketch(x) ^ near_dedup.odd_sketch(y)).sum()) > near_dedup._bits_at(percent / 100)
