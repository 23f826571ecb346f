"""Column expressions over alignments and intervals; coordinates are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alignment flag bits.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 32, 64, 128, 256, 1024, 2048


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) != 0


def is_primary(flag: Column) -> Column:
    return flag.bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0


def well_mapped(flag: Column, mapq: Column, min_mapq: int | None, dedup: bool) -> Column:
    """Mapped, at least min_mapq, and no duplicate if those are removed."""
    out = ~has(flag, UNMAPPED)
    if min_mapq is not None:
        out = out & (mapq >= min_mapq)
    if dedup:
        out = out & ~has(flag, DUPLICATE)
    return out


def cigar_length(cigar: Column) -> Column:
    """Bases of the axis that an alignment spans: clips, insertions and padding don't count."""
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(F.transform(sizes, lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)


def fragment_start(pos: Column, length: Column, reverse: Column, ext: Column) -> Column:
    """Where a read extended from its 5' end begins; a null ext keeps the read."""
    return F.when(reverse & ext.isNotNull(), pos + length - ext).otherwise(pos)


def fragment_end(pos: Column, length: Column, reverse: Column, ext: Column) -> Column:
    return F.when(reverse | ext.isNull(), pos + length - 1).otherwise(pos + ext - 1)


def trunc_div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return (F.signum(a.cast("double")) * F.floor(F.abs(a) / b)).cast("long")


def clamp(x: Column, length: Column) -> Column:
    return F.greatest(F.lit(1), F.least(x, length))


def strand_ok(a: Column, b: Column) -> Column:
    return (a == b) | (a == "*") | (b == "*")
