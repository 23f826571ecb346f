"""Alignments from SAM text, and axis catalogues from its header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cigar_length
from ..params import warn

#: Columns of every reads table.
READS = ("library", "qname", "flag", "chrom", "pos", "mapq", "aln_len", "mate_chrom", "mate_pos")


def read_sam(spark: SparkSession, path: str, library: str | None = None) -> DataFrame:
    """READS rows of SAM files; the library is the file's name unless given. Unplaced records have chrom null."""
    is_record = ~F.col("value").startswith("@") & (F.col("value") != "")
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(is_record)
    f = F.when(is_record, F.split("value", "\t"))  # a filter on a field may be moved before that on the lines
    name = F.lit(library) if library else F.regexp_extract("file", r"([^/]+?)(?:\.sam)?$", 1)
    star = lambda c: F.when(c != "*", c)
    chrom, mate = f[2], f[6]
    return lines.select(
        name.alias("library"), f[0].alias("qname"), f[1].cast("int").alias("flag"), star(chrom).alias("chrom"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"),
        cigar_length(f[5]).alias("aln_len"), F.when(mate == "=", star(chrom)).otherwise(star(mate)).alias("mate_chrom"), f[7].cast("int").alias("mate_pos"),
    )


def read_sam_axes(spark: SparkSession, path: str) -> DataFrame:
    """(file, chrom, length) from the @SQ lines."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(F.col("value").startswith("@SQ"))
    return lines.select("file", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("length"))


def axis_catalog(headers: DataFrame, restrict: tuple[str, ...] | None = None) -> DataFrame:
    """(chrom, length, ord) of the axes that all files have, from (file, chrom, length).

    Lengths that differ are reconciled to the least, with a warning. Unknown names in restrict are
    ignored. ord follows the names' binary order. A row for each axis, so one window is enough.
    """
    files = headers.select("file").distinct().count()
    axes = headers.groupBy("chrom").agg(F.min("length").alias("length"), F.max("length").alias("longest"), F.countDistinct("file").alias("n")).filter(F.col("n") == files)
    if restrict:
        axes = axes.filter(F.col("chrom").isin(*restrict))
    if axes.filter("length <> longest").limit(1).count():
        warn("axis lengths differ between files: the least is used")
    return axes.select("chrom", "length", F.row_number().over(Window.orderBy("chrom")).alias("ord"))


def leftover_count(reads: DataFrame, chroms: tuple[str, ...]) -> int:
    """Records on no selected axis, unplaced ones included."""
    return reads.filter(F.col("chrom").isNull() | ~F.col("chrom").isin(*chroms)).count()
