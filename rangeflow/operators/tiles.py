"""Counting fragments over sliding windows, bins and given regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import REVERSE, has
from ..params import ExtractParams, warn
from ..plans.containers import CountSet
from ..plans.intervals import interval_join, is_small
from .extract import fragments, library_summary, single_reads, valid_pairs


def window_bounds(k: Column, length: Column, width: int, spacing: int, shift: int) -> tuple[Column, Column]:
    """Start and end of window k (0-based), clipped to the axis."""
    centre = k * spacing + 1 + (0 if shift < width else spacing)
    return F.greatest(F.lit(1), centre - shift), F.least(length, centre - shift + width - 1)


def window_number(length: Column, width: int, spacing: int, shift: int) -> Column:
    return F.floor((length + shift - 1) / spacing) + (1 if shift < width else 0)


def window_grid(axes: DataFrame, width: int, spacing: int, shift: int = 0) -> DataFrame:
    """(chrom, k, start, end) of every window."""
    rows = axes.withColumn("n", window_number(F.col("length"), width, spacing, shift)).filter("n > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start, end = window_bounds(F.col("k"), F.col("length"), width, spacing, shift)
    return rows.select("chrom", F.col("k").cast("long").alias("k"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def _check(width: int, spacing: int, shift: int) -> None:
    if width <= 0 or spacing <= 0:
        raise ValueError("width and spacing must be positive")
    if not 0 <= shift < spacing:
        raise ValueError("shift must be at least 0 and below spacing")


def count_on_grid(frags: DataFrame, axes: DataFrame, width: int, spacing: int, shift: int = 0, keys: tuple[str, ...] = ("library",)) -> DataFrame:
    """(keys..., chrom, k, n): each fragment names its windows by arithmetic, so no join is needed."""
    first = 1 if shift < width else 1 + spacing  # centre of window 0
    lo = F.ceil((F.col("start") - first + shift - width + 1) / spacing)
    hi = F.floor((F.col("end") - first + shift) / spacing)
    rows = frags.join(F.broadcast(axes.select("chrom", "length")), "chrom")  # a row for each axis
    rows = rows.withColumns({"lo": F.greatest(F.lit(0), lo), "hi": F.least(window_number(F.col("length"), width, spacing, shift) - 1, hi)}).filter("lo <= hi")
    return rows.select(*keys, "chrom", F.explode(F.sequence("lo", "hi")).alias("k")).groupBy(*keys, "chrom", "k").agg(F.count("*").alias("n"))


def _placed(counts: DataFrame, axes: DataFrame, width: int, spacing: int, shift: int, keys: tuple[str, ...]) -> DataFrame:
    start, end = window_bounds(F.col("k"), F.col("length"), width, spacing, shift)
    rows = counts.join(F.broadcast(axes.select("chrom", "length")), "chrom")
    return rows.select(*keys, "chrom", "k", start.cast("long").alias("start"), end.cast("long").alias("end"), "n")


def _enough(counts: DataFrame, least: int, window: list[str]) -> DataFrame:
    """counts of windows that have at least `least` over all libraries."""
    if least <= 1:
        return counts
    sums = counts.groupBy(*window).agg(F.sum("n").alias("_all")).filter(F.col("_all") >= least).drop("_all")
    return counts.join(sums, window)


def window_counts(reads: DataFrame, axes: DataFrame, params: ExtractParams | None = None, spacing: int = 50, width: int | None = None, ext=100, shift: int = 0, least: int = 10, bins: bool = False) -> CountSet:
    """Counts over sliding windows; bins=True counts each fragment once, by its 5' end or midpoint.

    least: windows with fewer fragments over all libraries are left out; 0 keeps empty windows.
    """
    params = params or ExtractParams()
    width = spacing if width is None else width
    keys = ("library", "strand") if params.forward == "split" else ("library",)
    if bins:
        spacing, shift, least = width, 0, min(1, least)
    _check(width, spacing, shift)
    if bins and params.pe == "both":
        mid = F.col("start") + F.floor((F.col("end") - F.col("start") + 1) / 2)
        frags = valid_pairs(reads, params).select("library", "chrom", mid.alias("start"), mid.alias("end"), F.lit("*").alias("strand"))
    else:
        frags = fragments(reads, axes, params, 1 if bins else ext)
    if not params.forward == "split":
        frags = frags.drop("strand")
    counts = count_on_grid(frags, axes, width, spacing, shift, keys)
    window = ["chrom", "k", *keys[1:]]
    if least <= 0:
        names = reads.select("library").distinct()
        grid = window_grid(axes, width, spacing, shift).select("chrom", "k").crossJoin(F.broadcast(names))  # empty windows are asked for: all of them, for each library
        if len(keys) > 1:
            grid = grid.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
        counts = grid.join(counts, [*keys, "chrom", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        counts = _enough(counts, least, window)
    placed = _placed(counts, axes, width, spacing, shift, keys)
    final = 1 if bins else ext[1] if isinstance(ext, tuple) else None
    return CountSet(placed, library_summary(reads, params), spacing=spacing, width=width, shift=shift, final_ext=final, params=params)


def region_counts(reads: DataFrame, axes: DataFrame, regions: DataFrame, params: ExtractParams | None = None, ext=100) -> CountSet:
    """Fragments overlapping each of regions(region_id, chrom, start, end), zeros included; strands of regions are ignored."""
    params = params or ExtractParams()
    if "strand" in regions.columns and regions.filter("strand <> '*'").limit(1).count():
        warn("the regions' strands are ignored")
    keys = ("library", "strand") if params.forward == "split" else ("library",)
    frags = fragments(reads, axes, params, ext)
    places = regions.select("region_id", "chrom", "start", "end")
    hits = interval_join(frags, places, small=is_small(places)).groupBy("r_region_id", *keys).agg(F.count("*").alias("n"))
    grid = places.crossJoin(F.broadcast(reads.select("library").distinct()))  # each region has a row for each library
    if len(keys) > 1:
        grid = grid.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    counts = grid.join(hits.withColumnRenamed("r_region_id", "region_id"), ["region_id", *keys], "left")
    counts = counts.select("region_id", *keys, "chrom", "start", "end", F.coalesce("n", F.lit(0)).alias("n"))
    final = ext[1] if isinstance(ext, tuple) else None
    return CountSet(counts, library_summary(reads, params), final_ext=final, params=params)


def stranded_counts(reads: DataFrame, axes: DataFrame, params: ExtractParams | None = None, regions: DataFrame | None = None, **kwargs) -> CountSet:
    """window_counts or region_counts with strands kept apart, in one pass; libraries gain totals of each strand."""
    params = params or ExtractParams(forward="split")
    if params.forward != "split":
        raise ValueError("stranded counts need forward='split'")
    out = window_counts(reads, axes, params, **kwargs) if regions is None else region_counts(reads, axes, regions, params, **kwargs)
    reverse = has(F.col("flag"), REVERSE).cast("long")
    totals = single_reads(reads, params).groupBy("library").agg(F.sum(1 - reverse).alias("forward_total"), F.sum(reverse).alias("reverse_total"))
    libraries = out.libraries.join(totals, "library", "left").fillna(0, ["forward_total", "reverse_total"])
    return out.replace(libraries=libraries)
