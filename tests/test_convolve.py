"""Sums of products by distance against all pairs."""

from collections import Counter

import numpy as np
import pytest

from rangeflow.plans import convolve


@pytest.mark.parametrize("most", [2, 1000, 1 << 20, 1 << 26])
def test_products_are_exact(most):
    rng = np.random.default_rng(most)
    x, y = rng.integers(0, most, 500), rng.integers(0, most, 570)
    want = [sum(a * b for a, b in zip(x.tolist(), y[d : d + 500].tolist(), strict=True)) for d in range(71)]
    assert convolve.products(x, y, 70).tolist() == want


@pytest.mark.parametrize("few", [0, 50, convolve.FEW_PAIRS])
@pytest.mark.parametrize("max_dist", [1, 30, 100])
def test_blocks_give_all_pairs(spark, monkeypatch, few, max_dist):
    monkeypatch.setattr(convolve, "FEW_PAIRS", few)
    monkeypatch.setattr(convolve, "LEAST_BLOCK", 32)
    rng = np.random.default_rng(few + max_dist)
    sides = [{(c, int(p)): int(n) for c in "ab" for p, n in zip(rng.integers(1, 700, 150), rng.integers(1, 9, 150), strict=True)} for _ in range(2)]
    sides[0]["only left", 5] = sides[1]["only right", 5] = 3
    want = Counter()
    for (c, p), n in sides[0].items():
        for (d, q), m in sides[1].items():
            if c == d and 0 <= q - p <= max_dist:
                want[c, q - p] += n * m
    left, right = (spark.createDataFrame([(c, p, n) for (c, p), n in side.items()], "chrom string, pos bigint, n bigint") for side in sides)
    rows = convolve.products_by_delay(left, right, max_dist).collect()
    assert {(r["chrom"], r["delay"]): r["xy"] for r in rows} == dict(want)


def test_nothing_to_multiply(spark):
    none = spark.createDataFrame([], "chrom string, pos bigint, n bigint")
    assert convolve.products_by_delay(none, none, 10).collect() == []
