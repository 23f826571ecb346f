"""Exact quantiles against numpy, narrowed over several rounds, with ties, hot values and groups of one."""

import numpy as np
import pytest

from rangeflow.plans import quantiles


@pytest.mark.parametrize("p", [0.0, 0.31, 0.5, 0.75, 1.0])
def test_narrowed(spark, monkeypatch, p):
    monkeypatch.setattr(quantiles, "ONE_BLOCK", 20)
    monkeypatch.setattr(quantiles, "CUTS", 6)
    rng = np.random.default_rng(1)
    groups = {"even": rng.uniform(0, 1, 900), "steep": np.exp(rng.normal(0, 30, 700)), "tied": np.repeat([1.0, 2.0, 3.0], [100, 500, 50]), "one": np.array([7.0]), "two": np.array([-1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: r["q"] for r in quantiles.exact_quantile(df, "v", p, ("g",)).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert found[g] == pytest.approx(np.quantile(vs, p), rel=1e-12)
    all_values = np.concatenate(list(groups.values()))
    assert quantiles.exact_quantile(df, "v", p).first()["q"] == pytest.approx(np.quantile(all_values, p), rel=1e-12)


def test_without_values(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantile(df, "v", 0.5).first()["q"] is None
    assert quantiles.exact_quantile(df, "v", 0.5, ("g",)).count() == 0
