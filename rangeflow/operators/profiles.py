"""Read-level diagnostics: strand correlation, coverage profiles, width at half maximum, bimodality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import REVERSE, clamp, has
from ..params import ExtractParams
from ..plans.convolve import products_by_delay
from ..plans.intervals import interval_join, is_small
from ..plans.scans import block_scan
from .extract import fragments, single_reads

BLOCK_BASES = 1_000_000
#: Tiles with more sites than this are met in several tasks.
HOT_SITES = 10_000


def strand_positions(reads: DataFrame, axes: DataFrame, params: ExtractParams) -> DataFrame:
    """(chrom, length, reverse, pos, n): reads by 5' end, pooled over libraries; reverse reads stand one past their end."""
    rows = single_reads(reads, params).withColumn("reverse", has(F.col("flag"), REVERSE))
    rows = rows.join(F.broadcast(axes.select("chrom", "length")), "chrom")  # a row for each axis
    place = F.when(F.col("reverse"), F.least(F.col("length") + 1, F.col("pos") + F.col("aln_len"))).otherwise(F.greatest(F.lit(1), "pos"))
    return rows.groupBy("chrom", "length", "reverse", place.cast("long").alias("pos")).agg(F.count("*").alias("n"))


def correlate_reads(reads: DataFrame, axes: DataFrame, params: ExtractParams | None = None, max_dist: int = 1000, cross: bool = True) -> DataFrame:
    """(delay, rho) for 0..max_dist: correlation of forward and reverse counts (cross) or of all with themselves.

    Pearson over all positions of an axis, zeros included, averaged over axes by their reads; axes
    without reads, or for cross with one strand only, are left out. Sums are exact integers.
    """
    if max_dist <= 0:
        raise ValueError("the largest delay must be positive")
    places = strand_positions(reads, axes, params or ExtractParams())
    sums = places.groupBy("chrom", "length").agg(F.sum(F.when(~F.col("reverse"), F.col("n"))).alias("f"), F.sum(F.when(F.col("reverse"), F.col("n"))).alias("r"), F.sum("n").alias("reads"))
    if cross:
        sums = sums.filter("f is not null and r is not null")
        x, y = places.filter("not reverse").drop("reverse"), places.filter("reverse").drop("reverse")
    else:
        x = y = places.groupBy("chrom", "length", "pos").agg(F.sum("n").alias("n"))
    products = products_by_delay(x, y, max_dist)
    delays = sums.select("chrom", "length", "reads", F.explode(F.sequence(F.lit(0), F.lit(max_dist))).alias("delay"))

    def marginal(side: DataFrame, gone_from, name: str) -> DataFrame:
        """Sums of side and of its squares over the positions left at each delay: the total less those gone by then."""
        total = side.groupBy("chrom").agg(F.sum("n").alias("t1"), F.sum(F.col("n") * F.col("n")).alias("t2"))
        gone = side.withColumn("delay", gone_from).filter(F.col("delay") <= max_dist).groupBy("chrom", F.greatest(F.lit(0), "delay").alias("delay")).agg(F.sum("n").alias("g1"), F.sum(F.col("n") * F.col("n")).alias("g2"))
        along = Window.partitionBy("chrom").orderBy("delay").rowsBetween(Window.unboundedPreceding, 0)  # a row for each delay
        rows = delays.select("chrom", "delay").join(gone, ["chrom", "delay"], "left").select("chrom", "delay", F.coalesce(F.sum("g1").over(along), F.lit(0)).alias("g1"), F.coalesce(F.sum("g2").over(along), F.lit(0)).alias("g2"))
        return rows.join(total, "chrom").select("chrom", "delay", (F.col("t1") - F.col("g1")).alias(f"{name}1"), (F.col("t2") - F.col("g2")).alias(f"{name}2"))

    # x keeps positions 1..T-d with T = length + 1, y keeps 1+d..T
    mx = marginal(x, F.col("length") + 2 - F.col("pos"), "x")
    my = marginal(y, F.col("pos").cast("long"), "y")
    rows = delays.join(mx, ["chrom", "delay"]).join(my, ["chrom", "delay"]).join(products, ["chrom", "delay"], "left")
    big = lambda c: c.cast("decimal(38,0)")
    n = big(F.col("length") + 1 - F.col("delay"))
    top = n * big(F.coalesce("xy", F.lit(0))) - big(F.col("x1")) * big(F.col("y1"))
    vx, vy = n * big(F.col("x2")) - big(F.col("x1")) * big(F.col("x1")), n * big(F.col("y2")) - big(F.col("y1")) * big(F.col("y1"))
    usable = (F.col("length") + 1 - F.col("delay") >= 2) & (vx > 0) & (vy > 0)
    rho = F.when(usable, top.cast("double") / F.sqrt(F.when(usable, vx).otherwise(1).cast("double")) / F.sqrt(F.when(usable, vy).otherwise(1).cast("double"))).otherwise(0.0)
    return rows.withColumn("rho", rho).groupBy("delay").agg((F.sum(F.col("rho") * F.col("reads")) / F.sum("reads")).alias("rho"))


def best_delay(profile: DataFrame, ignore: int = 100) -> DataFrame:
    """(delay, rho) of the greatest correlation from delay `ignore` on; the smallest of equals."""
    best = F.max_by(F.struct("delay", "rho"), F.struct("rho", -F.col("delay")))
    return profile.filter(F.col("delay") >= ignore).agg(best.alias("b")).select("b.delay", "b.rho")


def _coverage_runs(frags: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """(chrom, strand, tile, part, start, next, value): runs of equal coverage, each up to the base before next, in tiles of size bases.

    Those of tiles(chrom, strand, tile, parts) are covered wholly, also by runs without coverage, and
    come as often as they have parts. A fragment makes two steps where it begins and ends and two for
    the tiles that it covers from their first base on, however long it is.
    """
    tile, place = lambda c: F.floor(c / size), ("chrom", "strand")
    step = lambda pos, d: F.struct(pos.alias("pos"), F.lit(d).cast("long").alias("d"))
    frags = frags.filter("start <= end")
    ends = F.array(step(F.col("start"), 1), F.when((F.col("end") + 1) % size != 0, step(F.col("end") + 1, -1)))
    steps = frags.select(*place, F.explode(ends).alias("s")).filter("s is not null").select(*place, "s.*")
    crossing = frags.withColumns({"first": tile(F.col("start")), "last": tile(F.col("end"))}).filter("last > first")
    changes = crossing.select(*place, F.explode(F.array(step(F.col("first") + 1, 1), step(F.col("last") + 1, -1))).alias("s")).groupBy(*place, F.col("s.pos").alias("tile")).agg(F.sum("s.d").alias("d"))
    along = Window.partitionBy(*place).orderBy("tile")  # a row for each tile
    carried = changes.select(*place, "tile", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("d"), F.lead("tile").over(along).alias("next"))
    carried = carried.filter("d > 0").select(*place, F.explode(F.sequence("tile", F.col("next") - 1)).alias("tile"), "d")
    for rows, d in ((carried, F.col("d")), (tiles, F.lit(0).cast("long"))):
        steps = steps.unionByName(rows.select(*place, (F.col("tile") * size).alias("pos"), d.alias("d")))
    steps = steps.groupBy(*place, "pos").agg(F.sum("d").alias("d")).withColumn("tile", tile(F.col("pos")))
    steps = steps.join(F.broadcast(tiles.filter("parts > 1")), [*place, "tile"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    along = Window.partitionBy(*place, "tile", "part").orderBy("pos")  # a row for each base of a tile at most
    value, after = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce(F.lead("pos").over(along), (F.col("tile") + 1) * size)
    return steps.select(*place, "tile", "part", F.col("pos").alias("start"), after.alias("next"), value.alias("value"))


def _values(frags: DataFrame, sites: DataFrame, reach: int, normalize: str, match: bool) -> DataFrame:
    """(region_id, offset, value): a value for each site and offset; only fragments and sites are dealt.

    A site that is given several times counts as often in its value.
    """
    size = max(1000, 2 * reach + 1)  # a site touches two tiles at most
    sites = sites.withColumn("strand", F.when(F.col("_flip"), "-").otherwise("+") if match else F.lit("*"))
    frags = frags if match else frags.withColumn("strand", F.lit("*"))
    placed = sites.groupBy("region_id", "chrom", "strand", "anchor", "_flip", "start", "end").agg(F.count("*").alias("times"))
    keys = ["chrom", "strand", "tile"]
    placed = placed.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    tiles = placed.groupBy(*keys).agg(F.ceil(F.count("*") / HOT_SITES).alias("parts"))
    placed = placed.join(F.broadcast(tiles.filter("parts > 1")), keys, "left").withColumn("part", F.pmod(F.xxhash64("region_id", "anchor"), F.coalesce("parts", F.lit(1)))).drop("parts")
    runs = _coverage_runs(frags, tiles, size)
    runs = runs.select(*[F.col(c).alias(f"r_{c}") for c in runs.columns])

    def met(placed: DataFrame) -> DataFrame:
        """placed with the first base, last base and value of each run that the site touches."""
        on = [F.col(c) == F.col(f"r_{c}") for c in (*keys, "part")]
        rows = placed.join(runs, [*on, F.col("r_start") <= F.col("end"), F.col("r_next") > F.col("start")])
        return rows.select(*placed.columns, F.greatest("start", "r_start").alias("lo"), F.least("end", F.col("r_next") - 1).alias("hi"), (F.col("r_value") * F.col("times")).cast("double").alias("value"))

    value = F.col("value")
    if normalize != "none":
        by = F.sum(value * (F.col("hi") - F.col("lo") + 1)) if normalize == "total" else F.max("value")
        placed = placed.join(met(placed).groupBy("region_id").agg(by.alias("by")), "region_id")
        value = F.when(F.col("by") > 0, value / F.col("by")).otherwise(F.lit(float("nan")))
    lo, hi = F.col("lo") - F.col("anchor"), F.col("hi") - F.col("anchor")
    rows = met(placed).select("region_id", "_flip", F.explode(F.sequence(lo, hi)).alias("at"), value.alias("value"))
    return rows.select("region_id", F.when(F.col("_flip"), -F.col("at")).otherwise(F.col("at")).cast("int").alias("offset"), "value")


def site_profile(reads: DataFrame, axes: DataFrame, regions: DataFrame, params: ExtractParams | None = None, reach: int = 5000, ext=100, average: bool = True, normalize: str = "none", strand: str = "ignore", skip_empty: bool = False) -> DataFrame:
    """(offset, value), or (region_id, offset, value) without averaging: coverage around region starts.

    normalize: none, or each site by its total or max first; a site without coverage then makes the
    mean NaN, unless skip_empty leaves such sites out. strand: ignore; use (reverse regions anchor at
    their end and are flipped); match (also only reads of the region's strand). Two signed steps for
    each fragment near a site replace a row for each base; without averaging, sites meet the runs of
    equal coverage of their tiles, and only the task that writes the values has a row for each.
    """
    params = params or ExtractParams()
    if strand == "match" and params.forward != "split":
        raise ValueError("strand='match' needs forward='split'")
    if normalize not in ("none", "total", "max") or strand not in ("ignore", "use", "match"):
        raise ValueError("unknown normalisation or strand mode")
    flip = F.lit(False) if strand == "ignore" else F.col("strand") == "-"
    sites = regions.withColumn("_flip", flip).withColumn("anchor", F.when(F.col("_flip"), F.col("end")).otherwise(F.col("start")).cast("long"))
    sites = sites.select("region_id", "chrom", "anchor", "_flip", (F.col("anchor") - reach).alias("start"), (F.col("anchor") + reach).alias("end"))
    if not average:
        return _values(fragments(reads, axes, params, ext), sites, reach, normalize, strand == "match")
    n_sites = sites.count()
    pairs = interval_join(fragments(reads, axes, params, ext), sites, bin_size=max(1000, 2 * reach), small=is_small(sites))
    if strand == "match":
        pairs = pairs.filter(F.when(F.col("r__flip"), "-").otherwise("+") == F.col("strand"))
    lo, hi = F.col("start") - F.col("r_anchor"), F.col("end") - F.col("r_anchor")
    lo, hi = F.when(F.col("r__flip"), -hi).otherwise(lo), F.when(F.col("r__flip"), -lo).otherwise(hi)
    steps = F.array(F.struct(F.greatest(F.lit(-reach), lo).cast("int").alias("offset"), F.lit(1).alias("d")), F.struct(F.least(F.lit(reach + 1), hi + 1).cast("int").alias("offset"), F.lit(-1).alias("d")))
    deltas = pairs.select(F.col("r_region_id").alias("region_id"), F.explode(steps).alias("s")).groupBy("region_id", "s.offset").agg(F.sum("s.d").alias("d"))
    offsets = reads.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("offset"))
    if normalize != "none":  # each site's own steps, 2 x reach + 2 at most
        along = Window.partitionBy("region_id").orderBy("offset")
        runs = deltas.withColumns({"cov": F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)), "next": F.coalesce(F.lead("offset").over(along), F.lit(reach + 1))})
        by = F.sum(F.col("cov") * (F.col("next") - F.col("offset"))) if normalize == "total" else F.max("cov")
        norms = runs.groupBy("region_id").agg(by.cast("double").alias("by"))
        deltas = deltas.join(norms, "region_id").withColumn("d", F.col("d") / F.col("by"))
    along = Window.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)  # a row for each offset
    sums = offsets.join(deltas.groupBy("offset").agg(F.sum("d").alias("d")), "offset", "left").withColumn("value", F.coalesce(F.sum("d").over(along), F.lit(0)).cast("double"))
    if normalize == "none":
        return sums.select("offset", (F.col("value") / F.lit(float(n_sites) or float("nan"))).alias("value"))
    covered = norms.agg(F.count("*").alias("covered"))
    rows = sums.crossJoin(F.broadcast(covered))  # one row
    share = F.lit(float(n_sites)) if not skip_empty else F.nullif(F.col("covered").cast("double"), F.lit(0.0))
    value = F.col("value") / share
    return rows.select("offset", value.alias("value") if skip_empty else F.when(F.col("covered") < n_sites, F.lit(float("nan"))).otherwise(value).alias("value"))


def half_max_width(profile: DataFrame, widths: DataFrame, ext: int = 100, proportion: float = 0.5) -> DataFrame:
    """(width): window size from the run around the profile's first maximum that stays at or above the proportion.

    widths(width) are those of the profiled regions; the profile has a row for each offset.
    """
    along = Window.orderBy("offset")
    top = profile.agg(F.max("value").alias("top"))
    rows = profile.crossJoin(F.broadcast(top)).withColumn("high", F.col("value") >= F.col("top") * proportion)  # one row
    rows = rows.withColumn("run", F.sum(F.when(F.col("high"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    peak = rows.filter(F.col("value") == F.col("top")).agg(F.min_by("run", "offset").alias("peak"))
    run = rows.filter("high").crossJoin(F.broadcast(peak)).filter(F.col("run") == F.col("peak")).agg(F.count("*").alias("run"))
    median = widths.agg(F.percentile("width", 0.5).alias("median"))
    value = F.col("run") - 2 * ext + 2 - F.col("median") + 1
    return run.crossJoin(median).select(F.greatest(F.lit(1.0), value.cast("double")).alias("width"))


def bimodality(reads: DataFrame, axes: DataFrame, regions: DataFrame, params: ExtractParams | None = None, width: int = 100, prior: float = 2.0, invert: bool = False) -> DataFrame:
    """(region_id, score): the largest strand-bimodality score over each region's bases, pooled over libraries.

    At a base, reads whose first `width` bases rightwards (or last leftwards) cover it are compared
    by strand. Without reads the score is 1; on an axis that isn't used it is null.
    """
    params = params or ExtractParams()
    rows = single_reads(reads, params)
    if rows.filter(F.col("aln_len") > width).limit(1).count():
        raise ValueError("an alignment is longer than the width")
    rows = rows.join(F.broadcast(axes.select("chrom", "length")), "chrom").withColumn("reverse", has(F.col("flag"), REVERSE))
    event = lambda pos, left, d: F.struct(pos.cast("long").alias("pos"), left.alias("left"), F.lit(d).alias("d"))
    last = F.col("pos") + F.col("aln_len") - 1
    ends = [(clamp(F.col("pos"), F.col("length")), clamp(F.col("pos") + width - 1, F.col("length")), F.lit(False)), (clamp(last - width + 1, F.col("length")), clamp(last, F.col("length")), F.lit(True))]
    events = F.array(*[e for lo, hi, left in ends for e in (event(lo, left, 1), event(hi + 1, left, -1))])
    rows = rows.select("chrom", "reverse", F.explode(events).alias("e"))
    pick = lambda left, reverse: F.sum(F.when((F.col("e.left") == left) & (F.col("reverse") == reverse), F.col("e.d")).otherwise(0))
    deltas = rows.groupBy("chrom", F.col("e.pos").alias("pos")).agg(pick(False, False).alias("lf"), pick(False, True).alias("lr"), pick(True, False).alias("rf"), pick(True, True).alias("rr"))
    deltas = deltas.withColumn("_block", F.floor(F.col("pos") / BLOCK_BASES))
    names = ("lf", "lr", "rf", "rr")
    runs = block_scan(deltas, ["chrom"], "_block", ["pos"], {f"c_{n}": ("sum", F.col(n)) for n in names})
    runs = block_scan(runs, ["chrom"], "_block", ["pos"], {"next": ("min", F.col("pos"))}, exclusive=True, reverse=True)
    c = {n: F.col(f"c_{n}") + prior for n in names}
    score = F.least(c["lr"] / c["lf"], c["rf"] / c["rr"]) if invert else F.least(c["lf"] / c["lr"], c["rr"] / c["rf"])
    segments = runs.filter("next is not null").select("chrom", F.col("pos").alias("start"), (F.col("next") - 1).alias("end"), score.cast("double").alias("score"))
    places = regions.select("region_id", "chrom", "start", "end")
    hits = interval_join(segments, places, small=is_small(places))
    covered = F.sum(F.least("end", "r_end") - F.greatest("start", "r_start") + 1)
    hits = hits.groupBy(F.col("r_region_id").alias("region_id")).agg(F.max("score").alias("best"), covered.alias("covered"))
    used = axes.filter(F.col("chrom").isin(*params.restrict)) if params.restrict else axes
    out = places.join(hits, "region_id", "left").join(F.broadcast(used.select("chrom", F.lit(True).alias("_used"))), "chrom", "left")
    gaps = F.coalesce(F.col("covered"), F.lit(0)) < F.col("end") - F.col("start") + 1  # bases before, after or between all reads score 1
    value = F.greatest(F.coalesce("best", F.lit(1.0)), F.when(gaps, 1.0).otherwise(F.coalesce("best", F.lit(1.0))))
    return out.select("region_id", F.when(F.col("_used"), value).alias("score"))
