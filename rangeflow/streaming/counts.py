"""Window counts over a stream of reads: those of single reads are additive, so update mode is exact; pairs wait for their mates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FIRST, MATE_UNMAPPED, PAIRED, REVERSE, SECOND, clamp, has, is_primary, well_mapped
from ..operators.extract import discarded, fragments, resized
from ..operators.tiles import count_on_grid
from ..params import ExtractParams


def streaming_window_counts(reads: DataFrame, axes: DataFrame, params: ExtractParams | None = None, spacing: int = 50, width: int | None = None, ext=100, shift: int = 0) -> DataFrame:
    """(library, chrom, k, n) of single-end reads arriving as a stream; write it in update or complete mode.

    The state is a row for each occupied window and library. Pairs are counted by streaming_pair_counts;
    extensions that differ between libraries are not offered, as these aren't known yet.
    """
    params = params or ExtractParams()
    if params.pe == "both":
        raise ValueError("pairs are counted by streaming_pair_counts")
    return count_on_grid(fragments(reads, axes, params, ext).drop("strand"), axes, width or spacing, spacing, shift)


def streaming_pairs(reads: DataFrame, axes: DataFrame, params: ExtractParams | None = None, time: str = "time", delay: str = "10 minutes", final: int | None = None) -> DataFrame:
    """(library, chrom, start, end, time) of the valid pairs of a stream of reads; write it in append mode.

    Mates meet if their times lie within delay of each other. A read waits as state until the
    watermark shows that no mate can come; it runs delay behind the latest time that both first and
    second reads have reached, and reads later than that are lost, as are those without a time. Reads that fail a filter never wait. time is that of the
    first read; final resizes fragments around their midpoints.
    """
    params = params or ExtractParams(pe="both")
    if params.pe != "both":
        raise ValueError("mates are paired with pe='both' only")
    flag = F.col("flag")
    keep = is_primary(flag) & well_mapped(flag, F.col("mapq"), params.min_mapq, params.dedup) & has(flag, PAIRED) & ~has(flag, MATE_UNMAPPED) & (F.col("chrom") == F.col("mate_chrom"))
    if params.restrict:
        keep = keep & F.col("chrom").isin(*params.restrict)
    rows = discarded(reads.filter(keep), params.discard).withColumn("reverse", has(flag, REVERSE)).withWatermark(time, delay)
    neither = F.raise_error(F.concat(F.lit("neither or both reads of the pair: "), F.col("qname"))).cast("boolean")
    is_first = F.when(has(flag, FIRST) == has(flag, SECOND), neither).otherwise(has(flag, FIRST))

    def side(first: bool, name: str) -> DataFrame:
        return rows.filter(is_first == first).select(*[F.col(c).alias(f"{name}_{c}") for c in ("library", "qname", "chrom", "pos", "mate_pos", "aln_len", "reverse")], F.col(time).alias(f"{name}_time"))

    same = " and ".join(f"a_{c} = b_{d}" for c, d in (("library", "library"), ("qname", "qname"), ("chrom", "chrom"), ("pos", "mate_pos"), ("mate_pos", "pos")))
    near = f"a_time between b_time - interval {delay} and b_time + interval {delay}"
    both = side(True, "a").join(side(False, "b"), F.expr(f"{same} and {near} and a_reverse <> b_reverse"))
    forward, reverse = ({c: F.when(F.col("a_reverse") == turned, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("pos", "aln_len")} for turned in (False, True))
    start, end = forward["pos"], reverse["pos"] + reverse["aln_len"] - 1
    both = both.filter(start <= end)
    if params.max_frag is not None:
        both = both.filter(end - start + 1 <= params.max_frag)
    start, end = resized(start, end, final)
    placed = both.select(F.col("a_library").alias("library"), F.col("a_chrom").alias("chrom"), start.alias("start"), end.alias("end"), F.col("a_time").alias(time))
    placed = placed.join(F.broadcast(axes.select("chrom", "length")), "chrom")  # a row for each axis
    return placed.select("library", "chrom", clamp(F.col("start"), F.col("length")).cast("long").alias("start"), clamp(F.col("end"), F.col("length")).cast("long").alias("end"), time)


def streaming_pair_counts(reads: DataFrame, axes: DataFrame, params: ExtractParams | None = None, spacing: int = 50, width: int | None = None, shift: int = 0, time: str = "time", delay: str = "10 minutes", every: str = "1 hour", final: int | None = None) -> DataFrame:
    """(period, library, chrom, k, n) of the pairs of each period of so long; write it in append mode.

    Counts are additive: those of all periods sum to the table's.
    """
    pairs = streaming_pairs(reads, axes, params, time, delay, final)
    return count_on_grid(pairs.withColumn("period", F.window(time, every)).drop(time), axes, width or spacing, spacing, shift, ("period", "library"))
