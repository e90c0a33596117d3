"""Pairs by bands with radii: every pair, few candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators.similarity import Bands, hamming_pairs, met_pairs


def table(spark, n, seed=1, runs=1):
    rng = np.random.default_rng(seed)
    h = rng.integers(-(2**63), 2**63, n, np.int64)
    # Every fifth hash is a neighbour of the one before, some bits away.
    for i in range(4, n, 5):
        h[i] = h[i - 1] ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 30), replace=False)))
    return h, spark.createDataFrame([(f"r{i // 5 % runs}", i, int(x)) for i, x in enumerate(h)], "run_id string, ordinal int, hash long")


def all_pairs(h, threshold, runs=1):
    out = set()
    for i in range(len(h)):
        d = np.bitwise_count((h[i + 1 :] ^ h[i]).view(np.uint64))
        out |= {(f"r{i // 5 % runs}", i, int(j), int(d[j - i - 1])) for j in np.flatnonzero(d <= threshold) + i + 1 if (i // 5 - j // 5) % runs == 0}
    return out


@pytest.mark.parametrize("threshold", [0, 1, 5, 12, 17, 23, 31, 64])
def test_all_pairs_at_any_threshold(spark, threshold):
    h, rows = table(spark, 300 if threshold < 64 else 60, runs=2)
    want = all_pairs(h, threshold, 2)
    assert {tuple(r) for r in hamming_pairs(rows, threshold).collect()} == want
    assert want or threshold < 5


@pytest.mark.parametrize("count", [3, 4, 6, 8])
def test_any_number_of_bands_finds_all_pairs(spark, count):
    h, rows = table(spark, 200)
    assert {tuple(r) for r in hamming_pairs(rows, 7, bands=Bands.of(7, count)).collect()} == all_pairs(h, 7)


def test_bands_are_few_and_wide():
    for t in range(64):
        for n in range(1, t + 2):
            b = Bands.of(t, n)
            # Were a pair beyond each radius, it would be beyond the threshold.
            assert sum(r + 1 for r in b.radius) > t or sum(r + 1 for r in b.radius) == t + 1
    assert len(Bands.fitted(17, 30_000, 30_000**2 // 2).low) < 9


@pytest.mark.parametrize("n", [3000, 30_000])
def test_candidates_of_a_wide_threshold(spark, n):
    """Far fewer meetings than pairs at 17 of 64 bits, where bands of one bit more than the threshold would meet nearly all."""
    _, rows = table(spark, n, seed=n)
    pairs = n * (n - 1) // 2
    bands = Bands.fitted(17, n, pairs)
    met = met_pairs(rows.repartition(4), 17, bands)
    count = met.count()
    assert count < 0.3 * pairs
    close = met.where(F.bit_count(F.col("hu").bitwiseXOR(F.col("hv"))) <= 17)
    assert count > close.count() > n // 12
