"""Each interval query that SQL can express gives the rows of its oracle SQL, also when every scan runs in blocks. Loess also against plain Python."""

import numpy as np
import pytest
from compare import differences

from rangeflow.operators import abundance, normalise, stats
from rangeflow.plans import scans
from rangeflow.plans.containers import CountSet
from rangeflow.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) == ""


def test_loess_offsets_are_centred(spark):
    rows = QUERIES["loess_offsets"](spark, SF_DIR).groupBy("region_id").avg("offset").collect()
    assert max(abs(r[1]) for r in rows) < 1e-6


SCANS = ["axis_table", "loess_offsets", "merge_clusters", "merge_signed", "merge_stranded", "merge_max_width", "weighted_bh", "cluster_fdr", "simes", "simes_blocked", "best_test", "empirical_fdr", "mixed_clusters", "bimodality", "proportion_filter", "tmm_factors"]


@pytest.mark.parametrize("name", SCANS)
def test_scans_in_blocks(spark, name, monkeypatch):
    monkeypatch.setattr(scans, "ONE_BLOCK", 5)
    monkeypatch.setattr(scans, "BLOCKS", 7)
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) == ""


HOT = ["simes", "empirical_fdr", "mixed_clusters", "overlap_simes", "overlap_empirical", "overlap_mixed", "consolidate_sizes"]


@pytest.mark.parametrize("name", HOT)
def test_hot_clusters_are_cut(spark, name, monkeypatch):
    """Clusters of more than three tests go by blocks, the others by windows."""
    monkeypatch.setattr(stats, "HOT_ROWS", 3)
    monkeypatch.setattr(stats, "BLOCKS", 4)
    monkeypatch.setattr(scans, "ONE_BLOCK", 5)
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) == ""


def test_a_hot_cluster_with_ties_and_zeros(spark, monkeypatch):
    rows = [(i, 1 if i % 10 else 2, [0.0, 0.2, 0.2, 0.9, 1.0][i * 7 % 5] if i % 3 else (i % 89) / 100, 1.0 + i % 4, 1.0 - i % 3) for i in range(400)]
    tests = spark.createDataFrame(rows, "range_id int, cluster_id int, PValue double, w double, logFC double")
    want = sorted(map(tuple, stats.combined(tests, weight="w").collect()))
    monkeypatch.setattr(stats, "HOT_ROWS", 50)
    monkeypatch.setattr(stats, "BLOCKS", 6)
    monkeypatch.setattr(scans, "ONE_BLOCK", 20)
    got = sorted(map(tuple, stats.combined(tests, weight="w").collect()))
    assert [r[:-2] + r[-1:] for r in got] == [r[:-2] + r[-1:] for r in want] and np.allclose([r[-2] for r in got], [r[-2] for r in want], rtol=1e-12)


def plain_lowess(x, y, span=0.3, rounds=4):
    """Robust local linear regression at every point, by its definition."""
    near = max(2, int(np.ceil(span * len(x))))
    robust, fit = np.ones(len(x)), None
    for _ in range(rounds):
        fit = np.empty(len(x))
        for i, p in enumerate(x):
            far = np.sort(np.abs(x - p))[near - 1]
            k = robust * np.clip(1 - (np.abs(x - p) / max(far, 1e-12)) ** 3, 0, None) ** 3
            slope, level = np.polyfit(x - p, y, 1, w=np.sqrt(k))
            fit[i] = level
        residual = np.abs(y - fit)
        robust = np.clip(1 - (residual / (6 * np.median(residual))) ** 2, 0, None) ** 2
    return fit


def test_loess_at_knots_is_near_the_fit_at_all_points(spark):
    rng = np.random.default_rng(3)
    n = 600
    level = rng.uniform(20, 400, n)
    y = {"a": rng.poisson(level * (1 + level / 800)), "b": rng.poisson(level)}
    rows = [(i, lib, int(v)) for lib, ys in y.items() for i, v in enumerate(ys)]
    libraries = spark.createDataFrame([(lib, int(ys.sum()), None, 50) for lib, ys in y.items()], "library string, total bigint, ext int, rlen int")
    counts = spark.createDataFrame(rows, "region_id bigint, library string, n bigint").selectExpr("region_id", "'c' as chrom", "1 as start", "50 as end", "library", "n")
    data = CountSet(counts, libraries)
    got = {(r["library"], r["region_id"]): r["offset"] for r in normalise.loess_offsets(data).collect()}
    sizes = np.array([ys.sum() for ys in y.values()], float)
    both = np.stack(list(y.values()), axis=1).astype(float)
    x = abundance.average_abundance(both, sizes, np.ones(n), 0.5, abundance.DISPERSION) * np.log(2)
    fits = np.stack([plain_lowess(x, np.log(both[:, k] + 0.5 * sizes[k] / sizes.mean())) for k in range(2)], axis=1)
    want = fits - fits.mean(axis=1, keepdims=True)
    for k, lib in enumerate(y):
        assert max(abs(got[(lib, i)] - want[i, k]) for i in range(n)) < 0.02
