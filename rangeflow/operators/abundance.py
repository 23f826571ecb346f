"""Average abundances and the filter statistics on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.containers import CountSet
from ..plans.quantiles import exact_quantile
from ..plans.scans import block_scan, value_blocks
from ..plans.tables import settle
from ..shipping import ship

#: Dispersion if none is known, and the prior count.
DISPERSION, PRIOR = 0.05, 2.0


def one_group(y: np.ndarray, offsets: np.ndarray, dispersion: np.ndarray, steps: int = 50, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """Log-scale negative binomial means of rows of y with the given offsets, by Fisher scoring; -inf for rows of zeros, NaN for those without weight."""
    weights = np.broadcast_to(np.asarray(weights, float), y.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = np.log((weights * y).sum(axis=1) / (weights * np.exp(offsets)).sum(axis=1))
    live = np.isfinite(beta)
    for _ in range(steps):
        mu = np.exp(beta[live, None] + offsets[live])
        weight = weights[live] / (1 + dispersion[live, None] * mu)
        step = ((y[live] - mu) * weight).sum(axis=1) / (mu * weight).sum(axis=1)
        beta[live] += step
        if not len(step) or np.abs(step).max() < 1e-10:
            break
    return beta


def average_abundance(y: np.ndarray, sizes: np.ndarray, scale: np.ndarray, prior: float | np.ndarray, dispersion: float | np.ndarray, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """log2 counts per million of rows of y, each divided by its scale: -inf at scale 0, NaN below; weights are those of the single counts."""
    prior = np.broadcast_to(np.asarray(prior, float), (len(y),))[:, None] * sizes / sizes.mean()
    ok = scale > 0
    safe = np.where(ok, scale, 1.0)
    beta = one_group(y + safe[:, None] * prior, np.log(sizes + 2 * prior), np.broadcast_to(np.asarray(dispersion, float), (len(y),)), weights=weights)
    out = (beta - np.log(safe) + np.log(1e6)) / np.log(2)
    return np.where(ok, out, np.where(scale == 0, -np.inf, np.nan))


def scaled_average(rows: DataFrame, sizes: list[float], scale: Column | float = 1.0, prior: Column | float = PRIOR, dispersion: Column | float = DISPERSION, out: str = "abundance", y: str = "y", weights: str | None = None) -> DataFrame:
    """Adds the average abundance of column y, an array of counts in the order of sizes; scale, prior and dispersion may differ by row.

    weights names an array with the weight of each count; a row whose weights are null counts evenly.
    """
    ship(rows.sparkSession)
    totals = np.array(sizes, float)

    @F.pandas_udf("double")
    def fit(counts: pd.Series, scales: pd.Series, priors: pd.Series, dispersions: pd.Series, weighted: pd.Series) -> pd.Series:
        if not len(counts):
            return pd.Series([], dtype="float64")
        each = np.stack([np.ones(len(totals)) if w is None else w for w in weighted]) if weights else 1.0
        return pd.Series(average_abundance(np.stack(counts.to_numpy()), totals, *(x.to_numpy(float) for x in (scales, priors, dispersions)), each))

    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return rows.withColumn(out, fit(F.col(y), as_column(scale).cast("double"), as_column(prior).cast("double"), as_column(dispersion).cast("double"), (F.col(weights) if weights else F.lit(None)).cast("array<double>")))


def fragment_length(data: CountSet) -> int:
    """The final extension, or the mean over libraries of their extension or read length, truncated."""
    if data.final_ext is not None:
        return data.final_ext
    value = data.libraries.agg(F.avg(F.coalesce("ext", "rlen")).alias("m")).first()["m"]
    return int(value) if value is not None else 1


def effective_width(start: Column, end: Column, length: int) -> Column:
    return end - start + 1 + length - 1


def genome_windows(axes: DataFrame, spacing: int) -> int:
    return axes.agg(F.sum(F.ceil(F.col("length") / spacing)).cast("long")).first()[0] or 0


def average_rank(df: DataFrame, value: str, out: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank of value in ascending order; ties share their mean rank. Equal values are one step of the scan."""
    steps = value_blocks(df.groupBy(*parts, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "_v")
    steps = block_scan(steps, list(parts), "block", ["_v"], {"_upto": ("sum", F.col("_c"))})
    steps = steps.select(*[F.col(c).alias(f"_p_{c}") for c in parts], "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(steps, [df[c] == steps[f"_p_{c}"] for c in parts] + [df[value] == steps["_v"]]).select(*df.columns, out)


def library_sizes(data: CountSet) -> tuple[list[str], list[float]]:
    """Names and effective sizes (totals times norm factors) of the libraries, by name."""
    factor = F.col("norm_factor") if "norm_factor" in data.libraries.columns else F.lit(1.0)
    rows = data.libraries.select("library", (F.col("total") * factor).alias("size")).orderBy("library").collect()
    return [r["library"] for r in rows], [float(r["size"]) for r in rows]


def _same_sizes(data: CountSet, back: CountSet) -> None:
    if sorted(map(tuple, data.libraries.select("library", "total").collect())) != sorted(map(tuple, back.libraries.select("library", "total").collect())):
        raise ValueError("data and background have other library sizes")


def filter_proportion(data: CountSet, axes: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(range..., abundance, filter): the share of the genome's windows that are no more abundant."""
    names, sizes = library_sizes(data)
    rows = settle(scaled_average(data.matrix(names), sizes, prior=prior))
    n, genome = rows.count(), genome_windows(axes, data.spacing)
    ranked = average_rank(rows.withColumn("_tied", F.round("abundance", 9)), "_tied", "rank")  # equal but for rounding
    share = F.col("rank") / n if genome <= n else 1 + (F.col("rank") - n) / genome
    return ranked.withColumn("filter", share.cast("double")).drop("rank", "_tied", "y")


def global_background(rows: DataFrame, axes: DataFrame, spacing: int, sizes: list[float], prior: float) -> float:
    """The abundance of a window with background coverage: the median over all windows of the genome, unseen ones lowest."""
    n, genome = rows.count(), genome_windows(axes, spacing)
    seen = n / genome if genome else 1.0
    if seen > 1:
        seen = 1.0
    if seen < 0.5:
        return float(average_abundance(np.zeros((1, len(sizes))), np.array(sizes), np.ones(1), prior, DISPERSION)[0])
    return exact_quantile(rows, "abundance", 1 - 0.5 / seen).first()[0]


def filter_global(data: CountSet, axes: DataFrame, background: CountSet | None = None, prior: float = PRIOR) -> DataFrame:
    """(range..., abundance, filter): log2 enrichment over the genome's typical window, or typical bin scaled to window width."""
    names, sizes = library_sizes(data)
    rows = settle(scaled_average(data.matrix(names), sizes, prior=prior))
    if background is None:
        level = global_background(rows, axes, data.spacing, sizes, prior)
    else:
        _same_sizes(data, background)
        width = lambda d: exact_quantile(d.ranges(), effective_width(F.col("start"), F.col("end"), fragment_length(d)), 0.5).first()[0]
        ratio = (width(background) or 1.0) / (width(data) or 1.0)  # without ranges any ratio will do
        bins = settle(scaled_average(background.matrix(names), sizes, scale=ratio, prior=prior))
        level = global_background(bins, axes, background.spacing, sizes, prior)
    return rows.withColumn("filter", F.col("abundance") - F.lit(level)).drop("y")


def filter_local(data: CountSet, background: CountSet, prior: float = PRIOR) -> DataFrame:
    """(range..., abundance, filter): log2 enrichment over each region's neighbourhood, its own counts taken out."""
    _same_sizes(data, background)
    names, sizes = library_sizes(data)
    rows = scaled_average(data.matrix(names), sizes, prior=prior)
    wide = background.matrix(names).select("region_id", F.col("y").alias("_by"), F.col("start").alias("_bs"), F.col("end").alias("_be"))
    dw = effective_width(F.col("start"), F.col("end"), fragment_length(data))
    bw = effective_width(F.col("_bs"), F.col("_be"), fragment_length(background))
    rows = rows.join(wide, "region_id").withColumn("_scale", (bw - dw) / dw)
    empty = F.col("_scale") <= 0
    rest = F.transform(F.arrays_zip("_by", "y"), lambda z: F.greatest(F.lit(0.0), z["_by"] - z["y"]))
    rows = rows.withColumn("_rest", F.when(empty, F.transform("y", lambda v: v * 0)).otherwise(rest)).withColumn("_scale", F.when(empty, 1.0).otherwise(F.col("_scale")))
    rows = scaled_average(rows, sizes, scale=F.col("_scale"), prior=prior, out="_back", y="_rest")
    return rows.withColumn("filter", F.col("abundance") - F.col("_back")).drop("y", "_by", "_bs", "_be", "_scale", "_rest", "_back")


def filter_control(data: CountSet, control: CountSet, norm: float | tuple[CountSet, CountSet] = 1.0, prior: float = PRIOR) -> DataFrame:
    """(range..., abundance, filter): log2 enrichment over control libraries at the same ranges.

    norm scales the control's sizes: a factor, or (data bins, control bins) whose median enrichment gives it.
    """
    if not isinstance(norm, (int, float)):
        median = exact_quantile(filter_control(norm[0], norm[1], 1.0, prior=0.0).filter(~F.isnan("filter") & (F.abs("filter") < float("inf"))), "filter", 0.5).first()[0]
        norm = 2 ** -(median or 0.0)
    names, sizes = library_sizes(data)
    c_names, c_sizes = library_sizes(control)
    c_sizes = [s * norm for s in c_sizes]
    keys = ["region_id"] if "region_id" in data.keys else ["chrom", "k"]
    rows = scaled_average(data.matrix(names), sizes, prior=prior)
    back = control.matrix(c_names).select(*keys, F.col("y").alias("_cy"), F.col("start").alias("_bs"), F.col("end").alias("_be"))
    rows = rows.join(back, keys)
    bw, dw = effective_width(F.col("_bs"), F.col("_be"), fragment_length(control)), effective_width(F.col("start"), F.col("end"), fragment_length(data))
    share = (sum(c_sizes) / len(c_sizes)) / (sum(sizes) / len(sizes))
    rows = scaled_average(rows, c_sizes, scale=bw / dw, prior=prior * share, out="_back", y="_cy")
    return rows.withColumn("filter", F.col("abundance") - F.col("_back")).drop("y", "_cy", "_bs", "_be", "_back")
