"""Gene features and the annotation of regions with those they overlap or lie near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import interval_join
from ..plans.scans import block_scan
from ..sources.genes import promoters, with_symbols

PROMOTER, BODY = 0, -1


def gene_features(exons: DataFrame, transcripts: DataFrame, symbols: DataFrame, axes: DataFrame, promoter: tuple[int, int] = (3000, 1000), max_intron: int = 1_000_000, names: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(internal, gene_id, symbol, chrom, start, end, strand, exon): exons numbered from 1, promoters 0, gene bodies -1.

    A gene on several axes or strands, or with a gap over max_intron, is several internal genes.
    Genes not on + count as on -.
    """
    plus = F.when(F.col("strand") == "+", "+").otherwise("-")
    rows = exons.select("gene_id", "chrom", "start", "end", plus.alias("strand"), F.lit(False).alias("prom"))
    rows = rows.unionByName(promoters(transcripts, axes, *promoter).select("gene_id", "chrom", "start", "end", plus.alias("strand"), F.lit(True).alias("prom")))
    along = Window.partitionBy("gene_id", "chrom", "strand").orderBy("start", "end", "prom")
    gap = F.col("start") - F.lag("end").over(along) - 1
    rows = rows.withColumn("part", F.sum(F.coalesce((gap > max_intron).cast("int"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    group = ["gene_id", "chrom", "strand", "part"]
    # genes are numbered in the order of their names: partitions that are ranges of it are the blocks of a scan
    ids = rows.select(*group).distinct().repartitionByRange(*group).withColumn("block", F.spark_partition_id())
    ids = block_scan(ids, [], "block", group, {"internal": ("sum", F.lit(1).cast("long"))}).drop("block")
    rows = rows.join(ids, group).drop("part")
    up = Window.partitionBy("internal", "prom").orderBy("start", "end")
    down = Window.partitionBy("internal", "prom").orderBy(F.desc("end"), F.desc("start"))
    number = F.when(F.col("prom"), PROMOTER).when(F.col("strand") == "+", F.row_number().over(up)).otherwise(F.row_number().over(down))
    rows = rows.withColumn("exon", number)
    bodies = rows.filter("not prom").groupBy("internal", "gene_id", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.lit(BODY).alias("exon"))
    out = with_symbols(rows.drop("prom").unionByName(bodies), symbols, names)
    return out.select("internal", "gene_id", "symbol", "chrom", "start", "end", "strand", "exon")


def _numbers(exons: Column) -> Column:
    """Feature numbers as text: runs as a-b, others by comma; "I" if only the gene body is there."""
    named = F.array_sort(F.array_distinct(F.filter(exons, lambda x: x != BODY)))
    first = F.filter(named, lambda x: ~F.array_contains(named, x - 1))
    last = F.filter(named, lambda x: ~F.array_contains(named, x + 1))
    text = F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))
    return F.when(F.size(named) == 0, "I").otherwise(F.array_join(text, ","))


def annotate_regions(regions: DataFrame, features: DataFrame, dist: int = 5000, ignore_strand: bool = True) -> DataFrame:
    """(region_id, overlap, left, right) for regions(region_id, chrom, start, end[, strand]).

    Each is a list of SYMBOL|FEATURES|STRAND; left and right name exons within dist that lie beyond
    the region, with the least distance in brackets.
    """
    places = regions.select("region_id", "chrom", "start", "end", *([] if ignore_strand else ["strand"]))
    features = features.select("internal", "symbol", "chrom", "start", "end", F.col("strand").alias("strand"), "exon")
    own = F.lit(None).cast("int")
    join = lambda gap: interval_join(places, features, bin_size=max(10_000, 2 * dist), gap=gap, stranded=not ignore_strand)
    columns = ["region_id", "mode", "r_internal", "r_symbol", "r_strand", "r_exon", "d"]
    inside = join(0).withColumns({"mode": F.lit("overlap"), "d": own}).select(columns)
    near = join(dist).filter(F.col("r_exon") > 0)
    left, right = F.col("start") - F.col("r_end"), F.col("r_start") - F.col("end")
    sides = near.withColumn("mode", F.when(left.between(1, dist), "left").when(right.between(1, dist), "right")).filter("mode is not null")
    sides = sides.withColumn("d", F.when(F.col("mode") == "left", left).otherwise(right).cast("int")).select(columns)
    genes = inside.unionByName(sides).groupBy("region_id", "mode", "r_internal", "r_symbol", "r_strand").agg(F.collect_list("r_exon").alias("exons"), F.min("d").alias("d"))
    text = F.concat("r_symbol", F.lit("|"), _numbers(F.col("exons")), F.lit("|"), "r_strand", F.when(F.col("d").isNotNull(), F.concat(F.lit("["), F.col("d").cast("string"), F.lit("]"))).otherwise(F.lit("")))
    lists = genes.select("region_id", "mode", F.struct("r_internal", text.alias("text")).alias("g"))
    pick = lambda m: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mode") == m, F.col("g")))), lambda g: g["text"]), ",").alias(m)
    out = lists.groupBy("region_id").agg(pick("overlap"), pick("left"), pick("right"))
    empty = lambda m: F.coalesce(m, F.lit("")).alias(m)
    return places.select("region_id").join(out, "region_id", "left").select("region_id", empty("overlap"), empty("left"), empty("right"))
