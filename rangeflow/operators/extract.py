"""From alignments to fragments: filters, blacklist, extension, mate pairing and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FIRST, MATE_UNMAPPED, PAIRED, REVERSE, SECOND, UNMAPPED, clamp, fragment_end, fragment_start, has, is_primary, trunc_div, well_mapped
from ..params import ExtractParams, fragment_lengths, warn
from ..plans.intervals import interval_join, is_small


def discarded(reads: DataFrame, discard: DataFrame | None, anti: bool = True) -> DataFrame:
    """reads without (or, with anti False, only) those wholly inside a discard range, by alignment width."""
    if discard is None:
        return reads if anti else reads.filter("false")
    columns = reads.columns
    placed = reads.withColumns({"start": F.col("pos"), "end": F.col("pos") + F.col("aln_len") - 1})
    ranges = discard.select("chrom", "start", "end")
    return interval_join(placed, ranges, within=True, how="left_anti" if anti else "left_semi", small=is_small(ranges)).select(columns)


def _strand(forward) -> Column:
    if forward in (None, "split"):
        return F.lit(True)
    return ~has(F.col("flag"), REVERSE) if forward else has(F.col("flag"), REVERSE)


def single_reads(reads: DataFrame, params: ExtractParams) -> DataFrame:
    """Reads that count on their own: filtered by flags, quality, strand, axis and blacklist."""
    keep = is_primary(F.col("flag")) & well_mapped(F.col("flag"), F.col("mapq"), params.min_mapq, params.dedup) & F.col("chrom").isNotNull() & _strand(params.forward)
    if params.pe in ("first", "second"):
        want, other = (FIRST, SECOND) if params.pe == "first" else (SECOND, FIRST)
        keep = keep & has(F.col("flag"), PAIRED) & has(F.col("flag"), want) & ~has(F.col("flag"), other)
    if params.restrict:
        keep = keep & F.col("chrom").isin(*params.restrict)
    return discarded(reads.filter(keep), params.discard)


def classify_mates(reads: DataFrame, params: ExtractParams) -> DataFrame:
    """A row for each primary record or pair with its class.

    Classes: single, one_mapped, inter, unoriented, valid, none (nothing passes). n_pass counts the
    reads of the row that pass the filters and the blacklist. Mates are joined on (library, qname,
    axis) and must name each other's position.
    """
    base = reads.filter(is_primary(F.col("flag")) & F.col("chrom").isNotNull())
    if params.restrict:
        base = base.filter(F.col("chrom").isin(*params.restrict))
    flag = F.col("flag")
    base = base.withColumns({"ok": well_mapped(flag, F.col("mapq"), params.min_mapq, params.dedup), "reverse": has(flag, REVERSE), "is_first": has(flag, FIRST), "is_second": has(flag, SECOND)})
    base = base.withColumn("kept", F.col("ok"))
    if params.discard is not None:
        inside = discarded(base, params.discard, anti=False).select("library", "qname", "flag", "chrom", "pos", F.lit(True).alias("gone")).distinct()
        base = base.join(inside, ["library", "qname", "flag", "chrom", "pos"], "left").withColumn("kept", F.col("ok") & F.col("gone").isNull()).drop("gone")
    plain = base.filter(~has(flag, PAIRED))
    alone = base.filter(has(flag, PAIRED) & has(flag, MATE_UNMAPPED))
    mated = base.filter(has(flag, PAIRED) & ~has(flag, MATE_UNMAPPED))
    mated = mated.withColumn("is_first", F.when(F.col("is_first") == F.col("is_second"), F.raise_error(F.concat(F.lit("neither or both reads of the pair: "), F.col("qname"))).cast("boolean")).otherwise(F.col("is_first")))
    far = mated.filter(~F.col("mate_chrom").eqNullSafe(F.col("chrom")))
    near = mated.filter(F.col("mate_chrom").eqNullSafe(F.col("chrom")))
    keys = ["library", "qname", "chrom"]
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in (*keys, "pos", "mate_pos", "aln_len", "reverse", "ok", "kept")])
    a, b = side(near.filter("is_first"), "a"), side(near.filter("not is_first"), "b")
    on = F.expr(" and ".join([*(f"a_{k} = b_{k}" for k in keys), "a_mate_pos = b_pos", "b_mate_pos = a_pos"]))
    pairs = a.join(b, on, "full_outer").withColumns({k: F.coalesce(f"a_{k}", f"b_{k}") for k in keys})
    both = F.coalesce(F.col("a_ok") & F.col("b_ok"), F.lit(False))
    fwd = lambda c: F.when(F.col("a_reverse"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    rev = lambda c: F.when(F.col("a_reverse"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    oriented = (F.col("a_reverse") != F.col("b_reverse")) & (fwd("pos") < rev("pos") + rev("aln_len"))
    count = lambda *cs: sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in cs), F.lit(0))
    pairs = pairs.select(
        *keys, F.when(both & oriented, "valid").when(both, "unoriented").when(count("a_ok", "b_ok") == 1, "one_mapped").otherwise("none").alias("class"),
        count("a_kept", "b_kept").alias("n_pass"), F.lit(None).cast("boolean").alias("is_first"), fwd("pos").alias("start"), (rev("pos") + rev("aln_len") - 1).alias("end"),
        (fwd("pos") + fwd("aln_len") - 1).alias("forward_end"), rev("pos").alias("reverse_start"),
    )
    one = lambda df, name: df.select(*keys, F.when(F.col("ok"), name).otherwise("none").alias("class"), F.col("kept").cast("int").alias("n_pass"), "is_first", F.col("pos").alias("start"), (F.col("pos") + F.col("aln_len") - 1).alias("end"))
    for rows, name in ((plain, "single"), (alone, "one_mapped"), (far, "inter")):
        pairs = pairs.unionByName(one(rows, name), allowMissingColumns=True)
    return pairs


#: The reads of a pair: places of its forward and its reverse read.
MATES = ("forward_start", "forward_end", "reverse_start", "reverse_end")


def valid_pairs(reads: DataFrame, params: ExtractParams, capped: bool = True, mates: bool = False) -> DataFrame:
    """(library, chrom, start, end) of properly oriented pairs whose reads both survive; with mates also the MATES."""
    out = classify_mates(reads, params).filter((F.col("class") == "valid") & (F.col("n_pass") == 2))
    if capped and params.max_frag is not None:
        out = out.filter(F.col("end") - F.col("start") + 1 <= params.max_frag)
    out = out.withColumns({"forward_start": F.col("start"), "reverse_end": F.col("end")})
    return out.select("library", "chrom", "start", "end", *(MATES if mates else ()))


def pair_diagnostics(reads: DataFrame, params: ExtractParams) -> DataFrame:
    """(library, measure, n): total, mapped, single, mate.unmapped, unoriented, inter.chr."""
    rows = classify_mates(reads, params)
    chosen = F.col("chrom").isin(*params.restrict) if params.restrict else F.col("chrom").isNotNull()
    counted = ~F.coalesce(chosen, F.lit(False)) | is_primary(F.col("flag"))
    libraries = reads.groupBy("library").agg(F.count(F.when(counted, 1)).alias("total"))
    count = lambda among: F.count(F.when(F.expr(among), 1))
    inter = F.expr("class = 'inter' and n_pass = 1")
    # one group for all that needs no look at a pair's other rows
    pairs = rows.groupBy("library", F.coalesce(inter, F.lit(False)).alias("inter"), F.when(inter, F.col("qname")).alias("pair")).agg(
        F.sum(F.when(F.col("class") != "none", F.col("n_pass"))).alias("mapped"), count("class = 'single' and n_pass = 1").alias("single"),
        count("class in ('valid', 'unoriented', 'one_mapped') and n_pass = 1").alias("alone"), count("class = 'unoriented' and n_pass = 2").alias("unoriented"),
        (F.min("is_first") != F.max("is_first")).alias("both"),
    )
    sums = pairs.groupBy("library").agg(
        F.sum("mapped").alias("mapped"), F.sum("single").alias("single"), (F.sum("alone") + count("inter and not both")).alias("mate.unmapped"),
        F.sum("unoriented").alias("unoriented"), count("inter and both").alias("inter.chr"),
    )
    names = ["total", "mapped", "single", "mate.unmapped", "unoriented", "inter.chr"]
    measures = F.array(*[F.struct(F.lit(n).alias("measure"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("long").alias("n")) for n in names])
    return libraries.join(sums, "library", "left").select("library", F.explode(measures).alias("m")).select("library", "m.measure", "m.n")


def pair_sizes(reads: DataFrame, params: ExtractParams) -> DataFrame:
    """(library, size) of all valid pairs; the size limit is not applied."""
    return valid_pairs(reads, params, capped=False).select("library", (F.col("end") - F.col("start") + 1).alias("size"))


def _extension(ext, reads: DataFrame) -> tuple[Column, int | None]:
    if not isinstance(ext, tuple) or ext[0] is None or isinstance(ext[0], int):
        each, final = (ext[0], ext[1]) if isinstance(ext, tuple) else (ext, None)
        fragment_lengths(ext, ["x"])
        if isinstance(ext, tuple) and final is None and each is not None:
            final = each
        return F.lit(each).cast("int"), final
    libraries = sorted(r[0] for r in reads.select("library").distinct().collect())
    each, final = fragment_lengths(ext, libraries)
    known = {k: v for k, v in each.items() if v is not None}
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("library")] if known else F.lit(None).cast("int"), final


def resized(start: Column, end: Column, final: int | None) -> tuple[Column, Column]:
    """The interval around the same midpoint with length final; an odd difference leaves one base."""
    if final is None:
        return start, end
    cut = trunc_div(end - start + 1 - final, 2)
    return start + cut, end - cut


def fragments(reads: DataFrame, axes: DataFrame, params: ExtractParams, ext=100, mates: bool = False) -> DataFrame:
    """(library, chrom, start, end, strand) of all retained fragments, clamped into their axis; with mates also the MATES of pairs."""
    kept = MATES if mates else ()
    if params.pe == "both":
        final = ext[1] if isinstance(ext, tuple) else None
        rows = valid_pairs(reads, params, mates=mates).withColumn("strand", F.lit("*"))
        start, end = resized(F.col("start"), F.col("end"), final)
    else:
        length, final = _extension(ext, reads)
        rows = single_reads(reads, params).withColumn("reverse", has(F.col("flag"), REVERSE))
        args = (F.col("pos"), F.col("aln_len"), F.col("reverse"), length)
        start, end = resized(fragment_start(*args), fragment_end(*args), final)
        rows = rows.withColumn("strand", F.when(F.col("reverse"), "-").otherwise("+"))
    rows = rows.select("library", "chrom", start.alias("start"), end.alias("end"), "strand", *kept)
    rows = rows.join(F.broadcast(axes.select("chrom", "length")), "chrom")  # a row for each axis
    return rows.select("library", "chrom", clamp(F.col("start"), F.col("length")).cast("long").alias("start"), clamp(F.col("end"), F.col("length")).cast("long").alias("end"), "strand", *kept)


def fetch_region(reads: DataFrame, axes: DataFrame, chrom: str, start: int, end: int, params: ExtractParams, ext=100, as_reads: bool = False) -> DataFrame:
    """Fragments overlapping one region; the scan is narrowed by the longest a fragment can reach.

    as_reads (pairs only) gives (library, chrom, MATES) of the pairs whose fragments overlap instead.
    Pairs of unlimited size need the whole axis.
    """
    as_reads = as_reads and params.pe == "both"
    found = lambda near: fragments(near, axes, params, ext, as_reads)
    columns = ("library", "chrom", *(MATES if as_reads else ("start", "end", "strand")))
    known = axes.filter(F.col("chrom") == chrom).select("length").first()
    if not known:
        raise ValueError(f"unknown axis {chrom}")
    if max(1, start) > min(end, known["length"]):
        raise ValueError(f"the region's start is behind its end or its axis: {chrom}:{start}-{end}")
    if params.restrict and chrom not in params.restrict:
        warn(f"{chrom} is not among the axes to use")
        return found(reads.filter("false")).select(*columns)
    near = reads.filter(F.col("chrom") == chrom)
    final = [ext[1]] if isinstance(ext, tuple) and ext[1] else []
    if params.pe != "both":
        each = ext[0] if isinstance(ext, tuple) else ext
        lengths = [x for x in (each if isinstance(each, list) else [each]) if x] + final
    else:
        lengths = [params.max_frag, *final] if params.max_frag is not None else None
    if lengths is not None:
        reach = max(lengths, default=0)
        near = near.filter((F.col("pos") <= end + reach) & (F.col("pos") + F.col("aln_len") >= start - reach))
    return found(near).filter((F.col("start") <= end) & (F.col("end") >= start)).select(*columns)


def library_summary(reads: DataFrame, params: ExtractParams, axes: DataFrame | None = None) -> DataFrame:
    """(library, total, ext, rlen): retained fragments and their mean size (pairs) or mean read length, rounded half to even."""
    mean = lambda c: F.bround(F.avg(c)).cast("int")
    if params.pe == "both":
        out = valid_pairs(reads, params).groupBy("library").agg(F.count("*").alias("total"), mean(F.col("end") - F.col("start") + 1).alias("ext"), F.lit(None).cast("int").alias("rlen"))
    else:
        out = single_reads(reads, params).groupBy("library").agg(F.count("*").alias("total"), F.lit(None).cast("int").alias("ext"), mean("aln_len").alias("rlen"))
    all_of = reads.select("library").distinct()
    return all_of.join(out, "library", "left").select("library", F.coalesce("total", F.lit(0)).alias("total"), "ext", "rlen")
