"""Combining tests within clusters: Simes, best test, one-sided forms, and their overlap variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scans import adjusted, block_scan, value_blocks
from ..plans.tables import settle

#: Fixed value: log-fold changes beyond it count as up or down.
FOLD = 0.5
#: Clusters of more tests are cut into blocks, by so many quantiles of their p-values.
HOT_ROWS, BLOCKS = 200_000, 256


def fold_columns(tests: DataFrame, fc=None) -> list[str]:
    """The log-fold change columns: those named, or all whose name contains logFC."""
    if fc is None:
        return [c for c in tests.columns if "logFC" in c]
    return [fc] if isinstance(fc, str) else list(fc)


def p_column(tests: DataFrame, p: str | None = None) -> str:
    name = p or "PValue"
    if name not in tests.columns:
        raise ValueError(f"no column {name} for p-values")
    return name


def _prepared(tests: DataFrame, key: str, p: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return tests.filter(F.col(key).isNotNull()).withColumns({"_p": F.col(p).cast("double"), "_w": w})


def _leader_by_window(rows: DataFrame, key: str, row: str) -> DataFrame:
    """rows with _at: ratio to the weight up to it, p and row of the test with the least ratio."""
    along = Window.partitionBy(key).orderBy("_p", row).rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.struct(F.col("_p") / F.col("_cum"), F.col("_p"), F.col(row))
    return rows.withColumn("_cum", F.sum("_w").over(along)).withColumn("_at", F.min(ratio).over(Window.partitionBy(key))).drop("_cum")


def _leader_by_blocks(rows: DataFrame, key: str, row: str, blocks: int) -> DataFrame:
    """The same for clusters of any size. Equal p-values of a cluster are one step of the scan.

    Weights are positive: along such a step the ratio falls to its last test, or stays 0 from the first on.
    """
    steps = settle(rows.groupBy(key, "_p").agg(F.sum("_w").alias("_sw"), F.when(F.col("_p") == 0, F.min(row)).otherwise(F.max(row)).alias("_row")))
    cuts = steps.groupBy(key).agg(F.percentile_approx("_p", [i / blocks for i in range(1, blocks)], 10_000).alias("_cuts"))
    steps = steps.join(cuts, key).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col("_p")))).drop("_cuts")
    steps = block_scan(steps, [key], "_block", ["_p"], {"_cum": ("sum", F.col("_sw"))})
    at = settle(steps.groupBy(key).agg(F.min(F.struct((F.col("_p") / F.col("_cum")).alias("col1"), F.col("_p"), F.col("_row").alias(row))).alias("_at")))
    return rows.join(at, key)


def simes(tests: DataFrame, key: str = "cluster_id", p: str | None = None, fc=None, weight: str | None = None, row: str = "range_id", blocks: int = 1) -> DataFrame:
    """(key, n, up/down counts of each fold column, p, fdr, direction) for each cluster: combined() with p adjusted."""
    return adjusted(combined(tests, key, p, fc, weight, row, blocks), "p", "fdr")


def combined(tests: DataFrame, key: str = "cluster_id", p: str | None = None, fc=None, weight: str | None = None, row: str = "range_id", blocks: int = 1) -> DataFrame:
    """simes() before the adjustment over clusters.

    p is the least p_(i) x total weight / weight up to i. direction (with one fold column) looks at
    the tests up to the first that attains it. Rows with a null key are left out. Clusters of more
    than HOT_ROWS tests, or with blocks > 1 all, are cut at the quantiles of their own p-values.
    """
    pv, folds = p_column(tests, p), fold_columns(tests, fc)
    rows = settle(_prepared(tests, key, pv, weight))
    if blocks <= 1 and rows.count() <= HOT_ROWS:
        rows = _leader_by_window(rows, key, row)
    else:
        hot = settle(rows.groupBy(key).count().filter(F.col("count") > (0 if blocks > 1 else HOT_ROWS)).select(key))
        blocks = blocks if blocks > 1 else BLOCKS
        rows = _leader_by_window(rows.join(hot, key, "left_anti"), key, row).unionByName(_leader_by_blocks(rows.join(hot, key), key, row, blocks))
    leads = F.struct("_p", row) <= F.struct(F.col("_at").getField("_p"), F.col("_at").getField(row))
    sums = [F.count("*").alias("n")]
    for f in folds:
        suffix = "" if len(folds) == 1 else f"_{f}"
        sums += [F.count_if(F.col(f) > FOLD).alias(f"up{suffix}"), F.count_if(F.col(f) < -FOLD).alias(f"down{suffix}")]
    sums += [(F.min(F.col("_at")["col1"]) * F.sum("_w")).alias("p")]
    if len(folds) == 1:
        up, down = F.count_if(leads & (F.col(folds[0]) > 0)) > 0, F.count_if(leads & (F.col(folds[0]) < 0)) > 0
        sums.append(F.when(up & ~down, "up").when(down & ~up, "down").otherwise("mixed").alias("direction"))
    return rows.groupBy(key).agg(*sums)


def best_test(tests: DataFrame, key: str = "cluster_id", p: str | None = None, weight: str | None = None, cpm: str | None = None, row: str = "range_id") -> DataFrame:
    """(key, best, p, fdr): the row with the least weighted p, Bonferroni-adjusted; or, with cpm, that of greatest abundance."""
    rows = _prepared(tests, key, p_column(tests, p), weight)
    if cpm:
        rank, value = F.struct(-F.col(cpm) / F.col("_w"), F.col(row)), F.col("_p")
        out = rows.groupBy(key).agg(F.min_by(row, rank).alias("best"), F.min_by(value, rank).alias("p"))
    else:
        rank = F.struct((F.col("_p") / F.col("_w")).alias("r"), F.col(row).alias("i"))
        out = rows.groupBy(key).agg(F.min(rank).alias("_m"), F.sum("_w").alias("_all"))
        out = out.select(key, F.col("_m.i").alias("best"), F.least(F.lit(1.0), F.col("_m.r") * F.col("_all")).alias("p"))
    return adjusted(out, "p", "fdr")


def one_sided(tests: DataFrame, p: str | None = None, fc=None) -> DataFrame:
    """Adds p_up and p_down: half the p-value on the side of the fold change, the rest on the other."""
    pv, folds = p_column(tests, p), fold_columns(tests, fc)
    if len(folds) != 1:
        raise ValueError("one log-fold change column is needed")
    half, up = F.col(pv) / 2, F.col(folds[0]) > 0
    return tests.withColumns({"p_up": F.when(up, half).otherwise(1 - half), "p_down": F.when(up, 1 - half).otherwise(half)})


def empirical_fdr(tests: DataFrame, key: str = "cluster_id", p: str | None = None, fc=None, weight: str | None = None, neg_down: bool = True, row: str = "range_id") -> DataFrame:
    """(key, n, up, down, p, fdr): clusters in the right direction against those as strong in the wrong one."""
    folds = fold_columns(tests, fc)
    sided = one_sided(tests, p, fc)
    right, wrong = ("p_up", "p_down") if neg_down else ("p_down", "p_up")
    sided = settle(sided)
    good = settle(combined(sided, key, right, folds, weight, row).drop("direction"))
    bad = combined(sided, key, wrong, folds, weight, row).select(F.col("p").alias("_p"), F.lit(0).alias("_right"), F.lit(1).alias("_wrong"))
    steps = bad.unionByName(good.select(F.col("p").alias("_p"), F.lit(1).alias("_right"), F.lit(0).alias("_wrong"))).groupBy("_p").agg(F.sum("_right").alias("_right"), F.sum("_wrong").alias("_wrong"))
    steps = block_scan(value_blocks(steps, "_p"), [], "block", ["_p"], {"_r": ("sum", F.col("_right")), "_f": ("sum", F.col("_wrong"))})
    steps = steps.filter("_right > 0").withColumn("_raw", F.least(F.lit(1.0), F.col("_f") / F.col("_r")))
    steps = block_scan(steps, [], "block", ["_p"], {"fdr": ("min", F.col("_raw"))}, reverse=True).select("_p", "fdr")
    return good.join(steps, good["p"] == steps["_p"]).drop("_p")


def mixed_clusters(tests: DataFrame, key: str = "cluster_id", p: str | None = None, fc=None, weight: str | None = None, row: str = "range_id") -> DataFrame:
    """(key, n, up, down, p, fdr): clusters that change in both directions (the larger of the two one-sided p-values)."""
    folds = fold_columns(tests, fc)
    sided = one_sided(tests, p, fc)
    sided = settle(sided)
    up = combined(sided, key, "p_up", folds, weight, row).drop("direction")
    down = combined(sided, key, "p_down", folds, weight, row).select(key, F.col("p").alias("_down"))
    return adjusted(up.join(down, key).withColumn("p", F.greatest("p", "_down")).drop("_down"), "p", "fdr")


def summit_weights(rows: DataFrame, key: str, summit: Column) -> DataFrame:
    """Adds weight: in each group rows / summits for summits, 1 for others; 0 where key or summit is null."""
    known = F.col(key).isNotNull() & F.col("_summit").isNotNull()
    out = settle(rows.withColumn("_summit", summit))
    sums = out.filter(known).groupBy(F.col(key).alias("_of")).agg((F.count("*") / F.nullif(F.count_if("_summit"), F.lit(0))).alias("_ratio"))
    out = out.join(sums, F.col(key) == F.col("_of"), "left")
    return out.withColumn("weight", F.when(~known, 0.0).when(F.col("_summit"), F.col("_ratio")).otherwise(1.0)).drop("_summit", "_of", "_ratio")


# -- regions and the windows that overlap them -----------------------------------------------------------


def _hits(hits: DataFrame, tests: DataFrame, o_weight: str | None, i_weight: str | None) -> tuple[DataFrame, str | None]:
    rows = hits.join(tests, "range_id")
    if o_weight or i_weight:
        rows = rows.withColumn("_weight", F.col(o_weight or i_weight))
        return rows, "_weight"
    return rows, None


def _all_regions(out: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions without windows get null results."""
    return regions.select("region_id").join(out, "region_id", "left")


def overlap_simes(hits: DataFrame, tests: DataFrame, regions: DataFrame, o_weight: str | None = None, i_weight: str | None = None, **kwargs) -> DataFrame:
    rows, weight = _hits(hits, tests, o_weight, i_weight)
    return _all_regions(simes(rows, "region_id", weight=weight, **kwargs), regions)


def overlap_best(hits: DataFrame, tests: DataFrame, regions: DataFrame, o_weight: str | None = None, i_weight: str | None = None, **kwargs) -> DataFrame:
    rows, weight = _hits(hits, tests, o_weight, i_weight)
    return _all_regions(best_test(rows, "region_id", weight=weight, **kwargs), regions)


def overlap_empirical(hits: DataFrame, tests: DataFrame, regions: DataFrame, o_weight: str | None = None, i_weight: str | None = None, **kwargs) -> DataFrame:
    rows, weight = _hits(hits, tests, o_weight, i_weight)
    return _all_regions(empirical_fdr(rows, "region_id", weight=weight, **kwargs), regions)


def overlap_mixed(hits: DataFrame, tests: DataFrame, regions: DataFrame, o_weight: str | None = None, i_weight: str | None = None, **kwargs) -> DataFrame:
    rows, weight = _hits(hits, tests, o_weight, i_weight)
    return _all_regions(mixed_clusters(rows, "region_id", weight=weight, **kwargs), regions)


def overlap_summits(hits: DataFrame, region_best: DataFrame | None = None, summits: DataFrame | None = None) -> DataFrame:
    """hits with weight: summits are each region's best window (region_id, best), or windows (range_id) named for all."""
    if (region_best is None) == (summits is None):
        raise ValueError("give the regions' best windows or the summit windows")
    if region_best is not None:
        rows = hits.join(region_best.select("region_id", "best"), "region_id", "left").withColumn("_is", F.coalesce(F.col("best") == F.col("range_id"), F.lit(False))).drop("best")
    else:
        rows = hits.join(summits.select("range_id", F.lit(True).alias("_is")).distinct(), "range_id", "left").withColumn("_is", F.coalesce("_is", F.lit(False)))
    return summit_weights(rows, "region_id", F.col("_is")).drop("_is")
