"""Merging windows into clusters, splitting wide clusters, and local maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import warn
from ..plans.containers import as_ranges
from ..plans.scans import block_scan
from ..plans.tables import settle

BLOCK_BASES = 1_000_000


def merge_windows(regions, tol: int, sign: str | None = None, max_width: int | None = None, ignore_strand: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """regions with cluster_id: single linkage of (range_id, chrom, start, end) along each axis.

    A window starts a cluster if more than tol bases lie between it and all before it (a negative
    tol asks for overlap), or if its boolean column `sign` differs from that of the last window that
    is not nested in earlier ones. Nested windows never split a cluster; those of the other sign are
    warned of. Clusters wider than max_width are cut into equal parts by window midpoints. Ids count
    from 1 in the order of axis name and position; with ignore_strand False strand by strand (+, -,
    *). within names columns whose values are clustered apart, each with ids of its own.
    """
    df = as_ranges(regions)
    parts = [*within, *([] if ignore_strand else ["strand"]), "chrom"]
    rows = df.withColumn("_block", F.floor(F.col("start") / BLOCK_BASES))
    order = ["start", "end", "range_id"]
    rows = block_scan(rows, parts, "_block", order, {"_reach": ("max", F.col("end"))}, exclusive=True)
    nested = F.coalesce(F.col("end") < F.col("_reach"), F.lit(False))
    new = F.col("_reach").isNull() | (F.col("start") - F.col("_reach") - 1 > tol)
    if sign:
        rows = block_scan(rows, parts, "_block", order, {"_last": ("last", F.when(~nested, F.col(sign)))}, exclusive=True)
        if rows.filter(nested & (F.col(sign) != F.col("_last"))).limit(1).count():
            warn("windows lie inside others of the opposite sign")
        new = new | (~nested & (F.col(sign) != F.col("_last")))
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    rows = block_scan(rows, parts, "_block", order, {"_local": ("sum", F.col("_new"))})
    if max_width is not None:
        rows = _split(rows, parts, max_width)
    # a row for each axis (and strand): the clusters before it
    counts = rows.groupBy(*parts).agg(F.max("_local").alias("_n"))
    by_strand = [] if ignore_strand else [F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(2)]
    before = Window.partitionBy(*within).orderBy(*by_strand, "chrom").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_p_{c}") for c in parts], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = rows.join(counts, [rows[c].eqNullSafe(counts[f"_p_{c}"]) for c in parts])
    return out.select(*df.columns, (F.col("_offset") + F.col("_local")).alias("cluster_id"))


def _split(rows: DataFrame, parts: list[str], max_width: int) -> DataFrame:
    extent = rows.groupBy(*parts, "_local").agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    width = F.col("_hi") - F.col("_lo") + 1
    cut = F.when(width > max_width, width / F.ceil(width / max_width))
    on = [*parts, "_local"]
    rows = rows.join(extent.withColumn("_cut", cut), on)
    bucket = F.coalesce(F.floor(((F.col("start") + F.col("end")) / 2 - F.col("_lo")) / F.col("_cut")), F.lit(0))
    rows = rows.withColumn("_bucket", bucket)
    # non-empty buckets numbered densely along the axis: a row for each cluster part
    names = rows.groupBy(*on, "_bucket").agg(F.min("_block").alias("_at"), F.lit(1).alias("_one"))
    names = block_scan(names.withColumn("_group", F.floor(F.col("_local") / 10_000)), parts, "_group", ["_local", "_bucket"], {"_new_local": ("sum", F.col("_one"))})
    names = names.select(*on, "_bucket", "_new_local")
    return rows.join(names, [*on, "_bucket"]).drop("_local").withColumnRenamed("_new_local", "_local")


def cluster_extents(clustered: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(cluster_id, chrom, start, end, n) of merge_windows' result."""
    strand = [F.first("strand").alias("strand")] if "strand" in clustered.columns else []
    return clustered.filter("cluster_id is not null").groupBy(*within, "cluster_id").agg(F.first("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), *strand, F.count("*").alias("n"))


def sizes_at_levels(regions: DataFrame, first: str, points: int, tol: int, sign: str | None = None, weight: str | None = None, ignore_strand: bool = True) -> DataFrame:
    """(chrom, grid, size): the summed weight of each cluster that merge_windows finds at each of so many grid points.

    A row belongs to the grid point in its column first and to all later ones. The scans carry one
    running value for each point, so that rows aren't copied for the points; only a row's cluster
    numbers are unfolded, and summed before they are dealt.
    """
    parts = [*([] if ignore_strand else ["strand"]), "chrom"]
    order = ["start", "end", "range_id"]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = regions.select(*parts, *order, F.col(first).alias("_first"), w.alias("_w"), *([F.col(sign).alias("_sign")] if sign else []), F.floor(F.col("start") / BLOCK_BASES).alias("_block"))
    rows._settled = getattr(regions, "_settled", False)  # columns of written rows
    base, grid = rows.columns, range(points)
    among = [F.col("_first") <= i for i in grid]

    rows = block_scan(rows, parts, "_block", order, {f"_reach{i}": ("max", F.when(among[i], F.col("end"))) for i in grid}, exclusive=True)
    reach = [F.col(f"_reach{i}") for i in grid]
    new = [F.coalesce(F.col("start") - reach[i] - 1 > tol, F.lit(True)) for i in grid]
    nested = [F.coalesce(F.col("end") < reach[i], F.lit(False)) for i in grid]
    if sign:
        rows = rows.select(*base, *[new[i].alias(f"_new{i}") for i in grid], *[nested[i].alias(f"_nested{i}") for i in grid])
        rows = block_scan(rows, parts, "_block", order, {f"_last{i}": ("last", F.when(among[i] & ~F.col(f"_nested{i}"), F.col("_sign"))) for i in grid}, exclusive=True)
        turned = [~F.col(f"_nested{i}") & (F.col("_sign") != F.col(f"_last{i}")) for i in grid]
        new = [F.coalesce(F.col(f"_new{i}") | turned[i], F.lit(True)) for i in grid]
    rows = rows.select(*base, *[(among[i] & new[i]).cast("long").alias(f"_new{i}") for i in grid])
    rows = block_scan(rows, parts, "_block", order, {f"_local{i}": ("sum", F.col(f"_new{i}")) for i in grid})
    numbers = F.array(*[F.when(among[i], F.struct(F.lit(i).alias("grid"), F.col(f"_local{i}").alias("_local"))) for i in grid])
    return rows.select(*parts, "_w", F.inline(F.filter(numbers, lambda x: x.isNotNull()))).groupBy(*parts, "grid", "_local").agg(F.sum("_w").alias("size")).drop("_local")


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest nodes (level, node) that make up first..last; a node of level k holds 2^k bases."""
    found = []
    for k in range(levels):
        lo, hi = F.shiftright(first + (2**k - 1), k), F.shiftright(last + 1, k)
        found += [F.when((lo < hi) & (lo.bitwiseAND(F.lit(1).cast("long")) == 1), _node(k, lo)), F.when((lo < hi) & (hi.bitwiseAND(F.lit(1).cast("long")) == 1), _node(k, hi - 1))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _node(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("_level"), number.alias("_node"))


def _holding(place: Column, levels: int) -> Column:
    """The nodes that hold a place."""
    return F.array(*[_node(k, F.shiftright(place, k)) for k in range(levels)])


def find_maxima(regions, reach: int, metric: str, ignore_strand: bool = True) -> DataFrame:
    """regions with is_max: no window within reach has a greater metric; ties are all maxima.

    The windows within reach of one either start there or lie across the first base there. The
    greatest metrics of both kinds are kept for nodes of 1, 2, 4, ... bases and looked up, so the
    rows grow with the windows and the logarithm of their length, not with the pairs within reach.
    """
    if reach <= 0:
        raise ValueError("the range must be positive")
    df = as_ranges(regions)
    parts = ["chrom", *(["strand"] if not ignore_strand else [])]
    checked = F.when(F.col(metric).isNull(), F.raise_error(F.lit("the metric is missing for a window")).cast("double")).otherwise(F.col(metric).cast("double"))
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    rows = df.select(*parts, start.alias("start"), end.alias("end"), checked.alias("_metric")).groupBy(*parts, "start", "end").agg(F.max("_metric").alias("_metric"))
    rows = settle(rows)
    longest = rows.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0]
    if longest is None:
        return df.withColumn("is_max", F.lit(None).cast("boolean"))
    # levels for the greatest ranges to be made up
    far, across = (longest + 2 * reach).bit_length(), max(1, longest.bit_length())
    starts = rows.groupBy(*parts, "start").agg(F.max("_metric").alias("_metric"))
    starts = starts.select(*parts, "_metric", F.lit(0).alias("_kind"), F.inline(_holding(F.col("start"), far)))
    lying = rows.select(*parts, "_metric", F.lit(1).alias("_kind"), F.inline(_cover(F.col("start"), F.col("end"), across)))
    keys = [*parts, "_kind", "_level", "_node"]
    nodes = starts.unionByName(lying).groupBy(*keys).agg(F.max("_metric").alias("_top"))
    lo, hi = F.col("start") - reach, F.col("end") + reach
    places = F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array(_cover(lo, hi, far), _holding(lo, across)))).alias("_kind", "_places")
    wanted = rows.select(*parts, "start", "end", places).select(*parts, "start", "end", "_kind", F.inline("_places"))
    tops = wanted.join(nodes, keys).groupBy(*parts, "start", "end").agg(F.max("_top").alias("_top"))
    return df.join(tops, [*parts, "start", "end"]).select(*df.columns, (F.col(metric).cast("double") >= F.col("_top")).alias("is_max"))
