"""Local trends from moments against the same fits on the points themselves."""

import numpy as np
import pytest

from rangeflow.plans import localfit, quantiles, scans


def plain_reaches(x, span, knots):
    near = min(len(x), max(2, int(np.ceil(span * len(x)))))
    places = np.unique(np.quantile(x, np.linspace(0, 1, min(len(x), knots))))
    return places, np.array([max(np.sort(np.abs(x - p))[near - 1], localfit.LEAST_REACH) for p in places])


def plain_trend(x, y, span, knots, rounds=4):
    places, reaches = plain_reaches(x, span, knots)
    w = np.ones(len(x))
    for left in range(rounds)[::-1]:
        values = []
        for p, h in zip(places, reaches, strict=True):
            k = w * np.clip(1 - (np.abs(x - p) / h) ** 3, 0, None) ** 3
            if not k.sum():
                values.append(np.nan)
                continue
            k = k / k.sum()
            mx, my = k @ x, k @ y
            variance = k @ (x - mx) ** 2
            steep = np.sqrt(variance) > localfit.LEAST_SPREAD * (places[-1] - places[0])
            values.append(my + (k @ ((x - mx) * (y - my)) / variance * (p - mx) if steep else 0))
        known = np.isfinite(values)
        trend = np.interp(x, places[known], np.array(values)[known])
        r = np.abs(y - trend)
        scale = 6 * np.median(r)
        if not left or scale < 1e-12:
            return trend
        w = np.clip(1 - (r / scale) ** 2, 0, None) ** 2


def samples():
    rng = np.random.default_rng(5)
    smooth = rng.uniform(0, 12, 500)
    tied = rng.choice([0.0, 0.5, 1.25, 7.0], 400, p=[0.6, 0.2, 0.1, 0.1])
    gap = np.concatenate([rng.normal(0, 1, 200), rng.normal(50, 0.1, 100)])
    return {"smooth": smooth, "ties": tied, "gap": gap, "one value": np.full(40, 3.0), "one point": np.array([2.0]), "two points": np.array([1.0, 4.0])}


@pytest.mark.parametrize("name", samples())
@pytest.mark.parametrize("blocks", [False, True])
def test_reaches(spark, monkeypatch, name, blocks):
    if blocks:
        monkeypatch.setattr(scans, "ONE_BLOCK", 20)
        monkeypatch.setattr(scans, "BLOCKS", 7)
    x = samples()[name]
    got = localfit.nearest_reaches(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 0.3, 50)
    places, reaches = plain_reaches(x, 0.3, 50)
    assert np.allclose([p for p, _ in got], places, rtol=0, atol=1e-12)
    assert np.allclose([h for _, h in got], reaches, rtol=0, atol=1e-12)


@pytest.mark.parametrize("name", ["smooth", "ties", "gap", "one value"])
def test_trend_is_that_of_the_points(spark, monkeypatch, name):
    x = samples()[name]
    rng = np.random.default_rng(6)
    if name == "smooth":
        monkeypatch.setattr(scans, "ONE_BLOCK", 50)
        monkeypatch.setattr(quantiles, "ONE_BLOCK", 50)
    ys = {"wave": np.sin(x) + rng.normal(0, 0.1, len(x)), "line": 2 * x + 1, "outliers": x + rng.normal(0, 0.2, len(x)) + (rng.random(len(x)) < 0.05) * 30}
    points = spark.createDataFrame([(g, i, float(a), float(b)) for g, y in ys.items() for i, (a, b) in enumerate(zip(x, y, strict=True))], "g string, i int, x double, y double")
    got = {(r["g"], r["i"]): r["trend"] for r in localfit.local_trend(points, "x", "y", "g", points.filter("g = 'wave'"), 0.3, knots=50).collect()}
    for g, y in ys.items():
        want = plain_trend(x, y, 0.3, 50)
        assert np.allclose([got[g, i] for i in range(len(x))], want, rtol=0, atol=1e-8), g


def test_no_points(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert localfit.local_trend(none, "x", "y", "g", none).collect() == []
