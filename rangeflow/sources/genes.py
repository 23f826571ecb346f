"""Gene models: exons, transcripts and symbols from GTF or from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exons, transcripts, symbols) of a GTF file; genes without gene_name have no symbol."""
    f = F.split("value", "\t")
    tag = lambda name: F.nullif(F.regexp_extract(f[8], rf'{name} "([^"]*)"', 1), F.lit(""))
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        f[2].alias("kind"), f[0].alias("chrom"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"), f[6].alias("strand"), tag("gene_id").alias("gene_id"), tag("gene_name").alias("symbol")
    )
    exons = rows.filter("kind = 'exon'").select("gene_id", "chrom", "start", "end", "strand").distinct()
    transcripts = rows.filter("kind = 'transcript'").select("gene_id", "chrom", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), "strand").distinct()
    return exons, transcripts, rows.filter("symbol is not null").select("gene_id", "symbol").distinct()


def promoters(transcripts: DataFrame, axes: DataFrame, upstream: int = 3000, downstream: int = 1000) -> DataFrame:
    """(gene_id, chrom, start, end, strand) around each transcript's start, trimmed to its axis."""
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("tx_start") - upstream).otherwise(F.col("tx_end") - downstream + 1)
    end = F.when(plus, F.col("tx_start") + downstream - 1).otherwise(F.col("tx_end") + upstream)
    rows = transcripts.join(F.broadcast(axes.select("chrom", "length")), "chrom")  # a row for each axis
    rows = rows.select("gene_id", "chrom", F.greatest(F.lit(1), start).alias("start"), F.least("length", end).alias("end"), "strand")
    return rows.filter("start <= end")


def with_symbols(genes: DataFrame, symbols: DataFrame, names: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds symbol: the names of the gene's first entry joined by ";", a missing one as <gene_id>."""
    first = symbols.groupBy("gene_id").agg(F.min(F.struct(*names)).alias("_s"))
    text = F.concat_ws(";", *[F.coalesce(F.col(f"_s.{n}").cast("string"), F.concat(F.lit("<"), "gene_id", F.lit(">"))) for n in names])
    return genes.join(first, "gene_id", "left").withColumn("symbol", text).drop("_s")
