"""False discovery over clusters: its estimate, its control by a threshold on windows, and combined analyses."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import warn
from ..plans.containers import as_ranges
from ..plans.intervals import interval_join, is_small
from ..plans.scans import adjusted, block_scan, value_blocks
from ..plans.tables import settle
from .clusters import cluster_extents, merge_windows, sizes_at_levels
from .stats import best_test, fold_columns, p_column, simes

#: Fixed value: thresholds may exceed the target by rounding only.
SLACK = 1.000001


@dataclass(frozen=True)
class Grid:
    """The grid search for a threshold: half-range in logits, points, rounds, and how much the range shrinks a round."""

    half_range: float = 10.0
    points: int = 21
    rounds: int = 5
    contraction: float = 4.0


def cluster_weights(ids: DataFrame, weight: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., cluster_id, size): the summed weight of each cluster."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return ids.filter("cluster_id is not null").groupBy(*within, "cluster_id").agg(F.sum(w).alias("size"))


def cluster_fdr(ids: DataFrame, threshold, weight: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., fdr): the share of clusters that the expected false windows could fill, smallest first.

    threshold is the FDR over windows at which ids were chosen: a number, or a column of within.
    Equal sizes are one step of the scan. Without clusters there is no row, or one with 0 if within is empty.
    """
    return _fdr_of_sizes(cluster_weights(ids, weight, within), threshold, within)


def _fdr_of_sizes(sizes: DataFrame, threshold, within: tuple[str, ...]) -> DataFrame:
    """cluster_fdr of (within..., size), a row for each cluster."""
    steps = sizes.groupBy(*within, "size").agg(F.count("*").alias("c"))
    steps = value_blocks(steps, "size")
    steps = block_scan(steps, list(within), "block", ["size"], {"upto": ("sum", F.col("size") * F.col("c"))})
    total = sizes.groupBy(*within).agg(F.sum("size").alias("all"), F.count("*").alias("clusters"))
    joined = steps.join(total, list(within)) if within else steps.crossJoin(F.broadcast(total))  # total is one row
    level = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    room = (F.col("all") * level - (F.col("upto") - F.col("size") * F.col("c"))) / F.col("size")
    fit = F.greatest(F.lit(0), F.least(F.col("c"), F.floor(room + 1e-9)))
    out = joined.groupBy(*within).agg((F.sum(fit) / F.first("clusters")).alias("fdr"))
    return out if within else out.select(F.coalesce("fdr", F.lit(0.0)).alias("fdr"))


def _expit(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def control_cluster_fdr(target: float, rows: DataFrame, adjp: str, cluster: Callable[[DataFrame, tuple[str, ...]], DataFrame], weight: str | None = None, batched: bool = True, search: Grid = Grid(), sizes: Callable[[DataFrame, str, int], DataFrame] | None = None) -> tuple[float, float]:
    """(threshold, fdr): the window threshold whose cluster FDR is nearest to target, the largest of equals.

    cluster maps significant rows to rows with cluster_id. With batched it takes the rows of all grid
    points at once with a column grid to cluster apart, one job a round; otherwise it is called for
    each point. sizes, if given, is asked instead of cluster: it maps rows, with the name of a column
    that holds the first grid point a row belongs to, and the number of points, to (grid, size) of
    all clusters, so that no row is copied for the points. The driver sees at most search.points
    numbers a round.
    """
    centre, half, best = math.log(target / (1 - target)), search.half_range, (target, 0.0)
    # no threshold lies above the target, so only rows up to it are written, once for all rounds
    kept = settle(rows.filter(F.col(adjp) <= target * SLACK))
    for _ in range(search.rounds):
        step = 2 * half / (search.points - 1)
        points = [_expit(centre - half + i * step) for i in range(search.points)]
        points = [x for x in points if x <= target * SLACK]
        if not points:
            break
        found = dict.fromkeys(points, 0.0)
        if sizes:
            levels = F.array(*map(F.lit, points))
            marked = kept.withColumn("_from", F.size(F.filter(levels, lambda x: x < F.col(adjp)))).filter(F.col("_from") < len(points))
            marked._settled = True  # some of the written rows
            clusters = sizes(marked, "_from", len(points)).withColumn("level", F.element_at(levels, F.col("grid") + 1))
            for r in _fdr_of_sizes(clusters, "level", ("grid", "level")).collect():
                found[points[r["grid"]]] = r["fdr"]
        elif batched:
            levels = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(x).alias("level")) for i, x in enumerate(points)])
            chosen = kept.select("*", F.inline(F.filter(levels, lambda g: g["level"] >= F.col(adjp))))
            ids = cluster(chosen, ("grid", "level"))
            for r in cluster_fdr(ids, "level", weight, ("grid", "level")).collect():
                found[points[r["grid"]]] = r["fdr"]
        else:
            for x in points:
                found[x] = cluster_fdr(cluster(kept.filter(F.col(adjp) <= x), ()), x, weight).first()["fdr"]
        level = max(points, key=lambda x: (-abs(found[x] - target), x))
        best = (level, found[level])
        centre, half = math.log(level / (1 - level)), half / search.contraction
    return best


def cluster_windows(regions, tests: DataFrame, target: float | None = None, tol: int | None = None, p: str | None = None, fc: str | None = None, weight: str | None = None, search: Grid = Grid(), **merge) -> tuple[DataFrame, DataFrame, float]:
    """(windows with cluster_id, clusters, FDR): clusters of significant windows at a target cluster FDR.

    cluster_id is null for windows that aren't significant. With fc clusters keep the sign of the
    fold change apart.
    """
    if target is None:
        target = 0.05
        warn("target FDR of 0.05 is used")
    if tol is None:
        tol = 100
        warn("tolerance of 100 bases is used")
    df = as_ranges(regions)
    extra = [c for c in (fc, weight) if c]
    keys = [c for c in ("set_id",) if c in df.columns and c in tests.columns]
    rows = df.join(tests.select("range_id", *keys, F.col(p_column(tests, p)).alias("_pv"), *extra), ["range_id", *keys])
    rows = adjusted(rows, "_pv", "_adj", weight)
    if fc:
        rows = rows.withColumn("_sign", F.col(fc) > 0)

    def cluster(chosen: DataFrame, within: tuple[str, ...]) -> DataFrame:
        return merge_windows(chosen, tol, "_sign" if fc else None, within=within, **merge)

    def sizes(marked: DataFrame, first: str, points: int) -> DataFrame:
        return sizes_at_levels(marked, first, points, tol, "_sign" if fc else None, weight, **merge)

    # clusters cut to a width depend on their extents: those are made for each point
    level, fdr = control_cluster_fdr(target, rows, "_adj", cluster, weight, search=search, sizes=None if merge.get("max_width") else sizes)
    ids = cluster(rows.filter(F.col("_adj") <= level), ())
    out = df.join(ids.select("range_id", *keys, "cluster_id"), ["range_id", *keys], "left")
    return out, cluster_extents(ids), fdr


def _pooled(sets: list[DataFrame]) -> DataFrame:
    out = None
    for i, s in enumerate(sets):
        s = as_ranges(s).withColumn("set_id", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def consolidate_clusters(sets: list[DataFrame], results: list[DataFrame], target: float | None = None, tol: int | None = None, equiweight: bool = True, **kwargs) -> tuple[DataFrame, DataFrame, float]:
    """cluster_windows over several analyses at once; a window counts 1 / windows of its set."""
    if len(sets) != len(results):
        raise ValueError("a result for each set of windows is needed")
    ranges, tests = _pooled(sets), None
    for i, t in enumerate(results):
        t = t.withColumn("set_id", F.lit(i))
        tests = t if tests is None else tests.unionByName(t)
    weight = None
    if equiweight:
        sizes = tests.groupBy("set_id").agg((1 / F.count("*")).alias("_even"))
        tests, weight = tests.join(F.broadcast(sizes), "set_id"), "_even"  # a row for each set
    return cluster_windows(ranges, tests, target, tol, weight=weight, **kwargs)


def consolidate_sizes(sets: list[DataFrame], results: list[DataFrame], tol: int | None = None, regions: DataFrame | None = None, equiweight: bool = True, p: str | None = None, fc=None, best: bool = False, overlap: dict | None = None, **merge) -> tuple[DataFrame, DataFrame]:
    """(windows with cluster_id, combined tests): windows of several sizes merged together, or grouped by regions.

    With equiweight each set has the same weight in a cluster, spread over its windows there.
    """
    ranges, tests = _pooled(sets), None
    for i, t in enumerate(results):
        t = t.withColumn("set_id", F.lit(i))
        tests = t if tests is None else tests.unionByName(t)
    if regions is None:
        if tol is None:
            tol = 100
            warn("tolerance of 100 bases is used")
        ids = merge_windows(ranges.withColumn("_old", F.col("range_id")).withColumn("range_id", F.struct("set_id", "_old")), tol, **merge)
        ids = ids.withColumn("range_id", F.col("_old")).drop("_old")
    else:
        places = regions.select("region_id", "chrom", "start", "end")
        ids = interval_join(ranges, places, small=is_small(places), **(overlap or {})).withColumnRenamed("r_region_id", "cluster_id")
    rows = ids.select("set_id", "range_id", "cluster_id").join(tests, ["set_id", "range_id"])
    weight = None
    if equiweight:
        sizes = rows.groupBy("cluster_id", "set_id").agg((1 / F.count("*")).alias("_even"))
        rows, weight = rows.join(sizes, ["cluster_id", "set_id"]), "_even"
    rows = rows.withColumn("_row", F.struct("set_id", "range_id"))
    out = best_test(rows, p=p, weight=weight, row="_row") if best else simes(rows, p=p, fc=fold_columns(tests, fc), weight=weight, row="_row")
    return ids, out
