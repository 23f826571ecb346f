"""Parameters, range coercion, library sizes and weights of counts: values and errors."""

import numpy as np
import pytest

from rangeflow.operators import abundance
from rangeflow.params import ExtractParams, fragment_lengths
from rangeflow.plans.containers import CountSet, as_ranges


def test_reform_by_short_names():
    base = ExtractParams(pe="both", max_frag=300, min_mapq=5)
    changed = base.reform(max=100, dedup=True, rest=["a", "b"])
    assert (changed.pe, changed.max_frag, changed.min_mapq, changed.dedup, changed.restrict) == ("both", 100, 5, True, ("a", "b"))
    assert (base.max_frag, base.dedup, base.restrict) == (300, False, None)
    assert base.reform() == base


@pytest.mark.parametrize("change,match", [({"d": 1}, "several"), ({"nothing": 1}, "names no"), ({"pe": "three"}, "pe must"), ({"forward": True}, "no single strand"), ({"max_frag": 0}, "positive")])
def test_reform_refuses(change, match):
    with pytest.raises(ValueError, match=match):
        ExtractParams(pe="both").reform(**change)


def test_text_of_parameters():
    text = str(ExtractParams(pe="both", max_frag=200, dedup=True, min_mapq=7, restrict=("a", "b")))
    assert all(x in text for x in ("pairs", "200", "removed", "7", "a, b", "none"))


@pytest.mark.parametrize("ext,want", [(100, ({"x": 100, "y": 100}, None)), (None, ({"x": None, "y": None}, None)), (([50, 101], None), ({"x": 50, "y": 101}, 75)), (([50, 101], 60), ({"x": 50, "y": 101}, 60))])
def test_fragment_lengths(ext, want):
    assert fragment_lengths(ext, ["x", "y"]) == want


@pytest.mark.parametrize("ext", [0, -5, ([10], None), ([10, 0], None), ([10, 20], 0), ([10, None], None)])
def test_wrong_fragment_lengths_are_refused(ext):
    with pytest.raises(ValueError):
        fragment_lengths(ext, ["x", "y"])


def test_ranges_of_other_things_are_refused(spark):
    for wrong in ("chr1:1-10", spark.createDataFrame([(1,)], "other int")):
        with pytest.raises((TypeError, ValueError)):
            as_ranges(wrong)


def counted(spark, rows, totals):
    counts = spark.createDataFrame(rows, "region_id bigint, chrom string, start int, end int, library string, n bigint")
    return CountSet(counts, spark.createDataFrame([(k, v, None, 50) for k, v in totals.items()], "library string, total bigint, ext int, rlen int"), spacing=50)


def test_backgrounds_of_other_library_sizes_are_refused(spark):
    rows = [(0, "a", 1, 50, "x", 3), (0, "a", 1, 50, "y", 5)]
    data, back = counted(spark, rows, {"x": 100, "y": 200}), counted(spark, rows, {"x": 100, "y": 201})
    axes = spark.createDataFrame([("a", 1000)], "chrom string, length int")
    with pytest.raises(ValueError, match="library sizes"):
        abundance.filter_global(data, axes, back)
    assert abundance.filter_global(data, axes, data).count() == 1


def plain_abundance(y, sizes, weights, prior, dispersion):
    """The root of the weighted score by bisection."""
    added = prior * sizes / sizes.mean()
    offset = np.log(sizes + 2 * added)
    low, high = -60.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        mu = np.exp(mid + offset)
        score = (weights * (y + added - mu) / (1 + dispersion * mu)).sum()
        low, high = (mid, high) if score > 0 else (low, mid)
    return (low + np.log(1e6)) / np.log(2)


def test_weights_of_counts(spark):
    rng = np.random.default_rng(4)
    sizes, even = np.array([1e4, 2e4, 5e4]), np.ones(3)
    rows = [(i, rng.poisson(30, 3).tolist(), None if i % 5 == 0 else rng.uniform(0.1, 4, 3).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, y array<bigint>, w array<double>")
    got = {r["i"]: r for r in abundance.scaled_average(abundance.scaled_average(df, list(sizes), weights="w"), list(sizes), out="plain").collect()}
    for i, y, w in rows:
        assert got[i]["abundance"] == pytest.approx(plain_abundance(np.array(y), sizes, even if w is None else np.array(w), 2.0, 0.05), abs=1e-8)
        assert got[i]["plain"] == pytest.approx(plain_abundance(np.array(y), sizes, even, 2.0, 0.05), abs=1e-8)
