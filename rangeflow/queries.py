"""A query for each operator over the derived tables, and its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import abundance, annotate, clusterfdr, clusters, extract, normalise, profiles, stats, tiles
from .params import ExtractParams
from .plans.containers import CountSet
from .plans.intervals import interval_join
from .plans.scans import adjusted
from .plans.tables import new_path
from .sources.genes import read_gtf
from .sources.sam import axis_catalog, leftover_count, read_sam
from .views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REGION_COLUMNS = ("region_id", "chrom", "start", "end")


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


# -- extraction --------------------------------------------------------------------------------------

KEPT = """mapq >= 10 and (flag & 1024) = 0 and not exists (select 1 from discard d where d.chrom = r.chrom and r.pos >= d.start and r.pos + r.aln_len - 1 <= d."end")"""


def strict(v: Views, **more) -> ExtractParams:
    return ExtractParams(min_mapq=10, dedup=True, discard=v.discard, **more)


@query("select chrom, max(length) as length, cast(row_number() over (order by chrom) as int) as ord from axes group by chrom", "axes")
def axis_table(v):
    return axis_catalog(v.axes.withColumn("file", F.lit("a")))


@query("select count(*) as n from reads where chrom not in ('chrC', 'chrP')", "reads")
def leftovers(v):
    return v.spark.createDataFrame([(leftover_count(v.reads, ("chrC", "chrP")),)], "n bigint")


@query(f"select library, qname, chrom, pos, aln_len from reads r where {KEPT}", "reads", "discard")
def filtered_reads(v):
    return extract.single_reads(v.reads, strict(v)).select("library", "qname", "chrom", "pos", "aln_len")


@query("""select library, qname, chrom, pos from reads r where exists (
    select 1 from discard d where d.chrom = r.chrom and r.pos >= d.start and r.pos + r.aln_len - 1 <= d."end")""", "reads", "discard")
def blacklisted_reads(v):
    return extract.discarded(v.reads, v.discard, anti=False).select("library", "qname", "chrom", "pos")


FRAGS = """select r.library, r.chrom, greatest(1, least(a.length, case when (flag & 16) > 0 then pos + aln_len - 100 else pos end))::bigint as start,
    greatest(1, least(a.length, case when (flag & 16) > 0 then pos + aln_len - 1 else pos + 99 end))::bigint as "end", case when (flag & 16) > 0 then '-' else '+' end as strand
    from reads r join axes a on r.chrom = a.chrom"""


@query(f"{FRAGS} where {KEPT}", "reads", "axes", "discard")
def fragments(v):
    return extract.fragments(v.reads, v.axes, strict(v), 100)


@query("""select library, chrom, greatest(1, least(length, s + c))::bigint as start, greatest(1, least(length, e - c))::bigint as "end", strand from (
    select r.library, r.chrom, length, strand, s, e, (sign(e - s + 1 - 90) * floor(abs(e - s + 1 - 90) / 2))::bigint as c from (
        select r.*, case when (flag & 16) > 0 then '-' else '+' end as strand,
            case when (flag & 16) > 0 then pos + aln_len - x else pos end as s, case when (flag & 16) > 0 then pos + aln_len - 1 else pos + x - 1 end as e
        from (select *, case library when 'lib0' then 80 when 'lib1' then 101 else aln_len end as x from reads) r) r join axes a on r.chrom = a.chrom)""", "reads", "axes")
def resized_fragments(v):
    return extract.fragments(v.reads, v.axes, ExtractParams(), ([80, 101, None], 90))


@query(f"select library, count(*) as total, null::int as ext, cast(round_even(avg(aln_len), 0) as int) as rlen from reads r where {KEPT} group by library", "reads", "discard")
def library_totals(v):
    return extract.library_summary(v.reads, strict(v))


@query(f"select * from ({FRAGS}) where chrom = 'chrP' and start <= 9000 and \"end\" >= 4000", "reads", "axes")
def region_fetch(v):
    return extract.fetch_region(v.reads, v.axes, "chrP", 4000, 9000, ExtractParams(), 100)


@query("select library, qname, chrom, pos, aln_len from reads where chrom in ('chrC', 'chrP') and (flag & 16) = 0", "reads")
def restricted_reads(v):
    return extract.single_reads(v.reads, ExtractParams(restrict=("chrC", "chrP", "chrX"), forward=True)).select("library", "qname", "chrom", "pos", "aln_len")


# -- pairs -------------------------------------------------------------------------------------------

MATES = """+marked as (select *, (mapq >= 10 and (flag & 1024) = 0) as ok, (flag & 16) > 0 as rev from pairs),
near as (
    select a.library, a.qname, a.chrom, a.ok as aok, b.ok as bok, a.rev as arev, b.rev as brev,
        case when a.rev then b.pos else a.pos end as start, case when a.rev then a.pos + a.aln_len - 1 else b.pos + b.aln_len - 1 end as "end"
    from marked a join marked b on a.qname = b.qname and a.library = b.library and a.chrom = b.chrom and (a.flag & 65) = 65 and (b.flag & 129) = 129 and a.mate_pos = b.pos and b.mate_pos = a.pos),
classes as (
    select library, chrom, start, "end", case when aok and bok and arev <> brev and start <= "end" then 'valid' when aok and bok then 'unoriented' when aok or bok then 'one_mapped' else 'none' end as class from near
    union all select library, chrom, pos, pos + aln_len - 1, case when not ok then 'none' when (flag & 1) = 0 then 'single' when (flag & 8) > 0 then 'one_mapped' else 'inter' end
    from marked where (flag & 1) = 0 or (flag & 8) > 0 or mate_chrom <> chrom)
"""


@query(MATES + "select library, class, count(*) as n from classes group by all", "pairs")
def pair_classes(v):
    return extract.classify_mates(v.pairs, ExtractParams(pe="both", min_mapq=10, dedup=True)).groupBy("library", "class").agg(F.count("*").alias("n"))


@query(MATES + "select library, \"end\" - start + 1 as size, count(*) as n from classes where class = 'valid' group by all", "pairs")
def pair_sizes(v):
    return extract.pair_sizes(v.pairs, ExtractParams(pe="both", min_mapq=10, dedup=True)).groupBy("library", "size").agg(F.count("*").alias("n"))


@query(MATES + """, inter as (select library, qname, count(distinct (flag & 64)) as sides from marked where (flag & 9) = 1 and mate_chrom <> chrom and ok group by all)
select library, measure, sum(n)::bigint as n from (
    select library, 'total' as measure, count(*) as n from marked group by all
    union all select library, 'mapped', count(*) from marked where ok group by all
    union all select library, 'single', count(*) from classes where class = 'single' group by all
    union all select library, 'mate.unmapped', count(*) from classes where class = 'one_mapped' group by all
    union all select library, 'mate.unmapped', count(*) from inter where sides = 1 group by all
    union all select library, 'unoriented', count(*) from classes where class = 'unoriented' group by all
    union all select library, 'inter.chr', count(*) from inter where sides = 2 group by all) group by all""", "pairs")
def pair_diagnostics(v):
    return extract.pair_diagnostics(v.pairs, ExtractParams(pe="both", min_mapq=10, dedup=True))


PAIR_READS = """, fetched as (select a.library, a.chrom, a.rev, case when a.rev then b.pos else a.pos end as fs, case when a.rev then b.pos + b.aln_len - 1 else a.pos + a.aln_len - 1 end as fe,
    case when a.rev then a.pos else b.pos end as rs, case when a.rev then a.pos + a.aln_len - 1 else b.pos + b.aln_len - 1 end as re
    from marked a join marked b on a.qname = b.qname and a.library = b.library and a.chrom = b.chrom and (a.flag & 65) = 65 and (b.flag & 129) = 129 and a.mate_pos = b.pos and b.mate_pos = a.pos
    where a.ok and b.ok and a.rev <> b.rev and a.chrom = 'chrP'),
near_region as (select * from fetched where fs <= re and re - fs + 1 <= 400 and fs <= 17000 and re >= 2000)
"""
FETCHED_PAIRS = ExtractParams(pe="both", min_mapq=10, dedup=True, max_frag=400)


@query(MATES + PAIR_READS + """select library, f.chrom, greatest(1, least(length, fs))::bigint as start, greatest(1, least(length, re))::bigint as "end", '*' as strand from near_region f join axes a on f.chrom = a.chrom""", "pairs", "axes")
def pair_fetch(v):
    return extract.fetch_region(v.pairs, v.axes, "chrP", 2000, 17000, FETCHED_PAIRS)


@query(MATES + PAIR_READS + "select library, chrom, fs as forward_start, fe as forward_end, rs as reverse_start, re as reverse_end from near_region", "pairs")
def pair_fetch_reads(v):
    return extract.fetch_region(v.pairs, v.axes, "chrP", 2000, 17000, FETCHED_PAIRS, as_reads=True)


@query("select library, qname, chrom, pos, aln_len from pairs where (flag & 193) = 65 and mapq >= 10", "pairs")
def first_mates(v):
    return extract.single_reads(v.pairs, ExtractParams(pe="first", min_mapq=10)).select("library", "qname", "chrom", "pos", "aln_len")


@query("select library, qname, chrom, pos, aln_len from pairs where (flag & 193) = 129 and (flag & 16) > 0", "pairs")
def second_mates(v):
    return extract.single_reads(v.pairs, ExtractParams(pe="second", forward=False)).select("library", "qname", "chrom", "pos", "aln_len")


# -- files -------------------------------------------------------------------------------------------

NAMED = """select 's' as library, qname, flag, chrom, pos, mapq, aln_len from reads"""


@query(NAMED, "reads")
def sam_reads(v):
    """The reads written as SAM text, with clips, an insertion and a deletion, and read back."""
    cigar = F.concat(F.lit("5S"), (F.col("aln_len") - 10).cast("string"), F.lit("M2I10D3H"))
    line = F.concat_ws("\t", "qname", "flag", "chrom", "pos", "mapq", cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    path = new_path(v.spark, "sam")
    v.reads.select(line.alias("value")).write.text(path)
    return read_sam(v.spark, path, "s").drop("mate_chrom", "mate_pos")


@query("select chrom, (max(length) - case when chrom < 'chrP' then 7 else 0 end)::int as length, cast(row_number() over (order by chrom) as int) as ord from axes where chrom <> 'chrS' group by chrom", "axes")
def axes_of_files(v):
    """Headers of two files: one lacks an axis and has shorter ones."""
    shorter = F.when(F.col("chrom") < "chrP", F.col("length") - 7).otherwise(F.col("length"))
    other = v.axes.filter("chrom <> 'chrS'").select("chrom", shorter.alias("length"), F.lit("b").alias("file"))
    return axis_catalog(v.axes.withColumn("file", F.lit("a")).unionByName(other))


GTF = "concat_ws('\t', chrom, 'made', '{kind}', {start}, {end}, '.', strand, '.', concat('gene_id \"', gene_id, '\"; gene_name \"n', gene_id, '\";')) as value"


def gene_files(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = new_path(v.spark, "gtf")
    lines = v.exons.selectExpr(GTF.format(kind="exon", start="start", end="`end`"))
    lines.unionByName(v.transcripts.selectExpr(GTF.format(kind="transcript", start="tx_start", end="tx_end"))).write.text(path)
    return read_gtf(v.spark, path)


@query('select distinct gene_id, chrom, start, "end", strand from exons', "exons")
def gtf_exons(v):
    return gene_files(v)[0]


@query("select distinct gene_id, chrom, strand, tx_start, tx_end, 'n' || gene_id as symbol from transcripts", "transcripts")
def gtf_transcripts(v):
    _, transcripts, symbols = gene_files(v)
    return transcripts.join(symbols, "gene_id")


# -- overlaps ----------------------------------------------------------------------------------------


def touching(v: Views, **how) -> DataFrame:
    placed = v.reads.select("read_id", "chrom", F.col("pos").alias("start"), (F.col("pos") + F.col("aln_len") - 1).alias("end"), F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"))
    return interval_join(placed, v.regions.select(*REGION_COLUMNS, "strand"), **how).select("read_id", F.col("r_region_id").alias("region_id"))


TOUCHING = "select read_id, region_id from reads a join regions r on a.chrom = r.chrom and "


@query(TOUCHING + 'pos >= start and pos + aln_len - 1 <= "end"', "reads", "regions")
def overlaps_within(v):
    return touching(v, within=True)


@query(TOUCHING + 'least(pos + aln_len - 1, "end") - greatest(pos, start) + 1 >= 15', "reads", "regions")
def overlaps_least(v):
    return touching(v, min_overlap=15)


@query(TOUCHING + 'pos <= "end" + 40 and pos + aln_len - 1 >= start - 40', "reads", "regions")
def overlaps_near(v):
    return touching(v, gap=40)


@query(TOUCHING + """pos <= "end" and pos + aln_len - 1 >= start and r.strand in ('*', case when (flag & 16) > 0 then '-' else '+' end)""", "reads", "regions")
def overlaps_stranded(v):
    return touching(v, stranded=True)


# -- counting ----------------------------------------------------------------------------------------

GRID = 'grid as (select chrom, k, greatest(1, k * 50 + 1 - 10)::bigint as start, least(length, k * 50 + 1 - 10 + 119)::bigint as "end" from axes, lateral (select unnest(range(cast(floor((length + 10 - 1) / 50) + 1 as bigint))) as k))'
WINDOWS = f"+frags as ({FRAGS}),\n{GRID},\nhits as (select f.library, f.strand, g.chrom, g.k, g.start, g.\"end\" from frags f join grid g on f.chrom = g.chrom and f.start <= g.\"end\" and f.\"end\" >= g.start)\n"
SLIDING = {"spacing": 50, "width": 120, "shift": 10}


@query(WINDOWS + 'select library, chrom, k, start, "end", count(*) as n from hits where (chrom, k) in (select (chrom, k) from hits group by chrom, k having count(*) >= 10) group by all', "reads", "axes")
def window_counts(v):
    return tiles.window_counts(v.reads, v.axes, least=10, **SLIDING).counts


@query(WINDOWS + 'select l.library, g.chrom, g.k, g.start, g."end", count(h.k) as n from grid g cross join (select distinct library from reads) l left join hits h on h.library = l.library and h.chrom = g.chrom and h.k = g.k group by all', "reads", "axes")
def window_counts_all(v):
    return tiles.window_counts(v.reads, v.axes, least=0, **SLIDING).counts


@query('select library, chrom, ((p - 1) // 500)::bigint as k, ((p - 1) // 500 * 500 + 1)::bigint as start, least(length, (p - 1) // 500 * 500 + 500)::bigint as "end", count(*) as n from fives group by all', "bins")
def bin_counts(v):
    return tiles.window_counts(v.reads, v.axes, width=500, bins=True).counts


@query(WINDOWS + 'select library, strand, chrom, k, start, "end", count(*) as n from hits where (chrom, k, strand) in (select (chrom, k, strand) from hits group by chrom, k, strand having count(*) >= 10) group by all', "reads", "axes")
def stranded_counts(v):
    return tiles.stranded_counts(v.reads, v.axes, least=10, **SLIDING).counts


@query("select library, count(*) as total, null::int as ext, cast(round_even(avg(aln_len), 0) as int) as rlen, count(*) filter ((flag & 16) = 0) as forward_total, count(*) filter ((flag & 16) > 0) as reverse_total from reads group by library", "reads")
def stranded_totals(v):
    return tiles.stranded_counts(v.reads, v.axes, least=10, **SLIDING).libraries


@query(f"""+frags as ({FRAGS}), libs as (select distinct library from reads)
select r.region_id, l.library, r.chrom, r.start, r."end", count(f.library) as n from regions r cross join libs l
left join frags f on f.library = l.library and f.chrom = r.chrom and f.start <= r."end" and f."end" >= r.start group by all""", "reads", "axes", "regions")
def region_counts(v):
    return tiles.region_counts(v.reads, v.axes, v.regions.select(*REGION_COLUMNS)).counts.select("region_id", "library", "chrom", "start", "end", "n")


@query(f"""+frags as ({FRAGS}), libs as (select distinct library from reads)
select r.region_id, l.library, r.chrom, r.start, r."end", count(f.library) as n from regions r cross join libs l
left join frags f on f.library = l.library and f.chrom = r.chrom and f.start <= r."end" and f."end" >= r.start group by all""", "reads", "axes", "regions")
def written_counts(v):
    """Region counts written as a container and read back."""
    folder = new_path(v.spark, "counts")
    counted_regions(v).write(folder)
    return CountSet.read(v.spark, folder).counts.select("region_id", "library", "chrom", "start", "end", "n")


@query(MATES + """, capped as (select * from classes where class = 'valid' and "end" - start + 1 <= 400)
select library, chrom, k, k * 100 + 1 as start, least(length, k * 100 + 150)::bigint as "end", n from (
    select f.library, f.chrom, a.length, k, count(*) as n from capped f join axes a on f.chrom = a.chrom, lateral (select unnest(range(cast(floor((a.length - 1) / 100) + 1 as bigint))) as k)
    where greatest(1, least(length, f.start)) <= least(length, k * 100 + 150) and greatest(1, least(length, f."end")) >= k * 100 + 1 group by all)""", "pairs", "axes")
def pe_window_counts(v):
    return tiles.window_counts(v.pairs, v.axes, ExtractParams(pe="both", min_mapq=10, dedup=True, max_frag=400), spacing=100, width=150, least=1).counts


# -- clusters ----------------------------------------------------------------------------------------


def merged(table: str, tol: int, key: str = "range_id", parts: str = "chrom", order: str = "chrom", sign: str | None = None, name: str = "ids") -> str:
    """CTEs of an independent reading of the merge: name(…, cluster_id) from table."""
    along = f'(partition by {parts} order by start, "end", {key} rows between unbounded preceding and 1 preceding)'
    split = f"or (not nested and {sign} is distinct from last_sign)" if sign else ""
    last = f"last_value(case when not nested then {sign} end ignore nulls) over {along}" if sign else "null"
    return f"""+{name}_a as (select *, max("end") over {along} as reach from {table}),
{name}_b as (select *, coalesce("end" < reach, false) as nested from {name}_a),
{name}_c as (select *, {last} as last_sign from {name}_b),
{name} as (select *, sum(case when reach is null or start - reach - 1 > {tol} {split} then 1 else 0 end) over (order by {order}, start, "end", {key})::bigint as cluster_id from {name}_c)
"""


EXTENT = 'select cluster_id, min(chrom) as chrom, min(start)::bigint as start, max("end")::bigint as "end", count(*) as n'


def regions_as_ranges(v: Views) -> DataFrame:
    return v.regions.withColumnRenamed("region_id", "range_id")


@query(merged("bins", 7) + f"{EXTENT} from ids group by cluster_id", "bins")
def merge_clusters(v):
    return clusters.cluster_extents(clusters.merge_windows(v.bins(), 7)).withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query(merged("signed", -20, "region_id", sign="s").replace("+", "+signed as (select *, region_id % 4 < 2 as s from regions),\n", 1) + "select region_id as range_id, cluster_id from ids", "regions")
def merge_signed(v):
    rows = regions_as_ranges(v).withColumn("s", F.col("range_id") % 4 < 2)
    return clusters.merge_windows(rows, -20, "s").select("range_id", "cluster_id")


@query(merged("regions", -30, "region_id", "strand, chrom", "case strand when '+' then 0 when '-' then 1 else 2 end, chrom") + "select region_id as range_id, cluster_id from ids", "regions")
def merge_stranded(v):
    return clusters.merge_windows(regions_as_ranges(v), -30, ignore_strand=False).select("range_id", "cluster_id")


@query(merged("bins", 7) + """, wide as (select *, min(start) over w as lo, max("end") over w - min(start) over w + 1 as width from ids window w as (partition by cluster_id)),
cut as (select *, case when width > 40 then floor(((start + "end") / 2 - lo) / (width / ceil(width / 40))) else 0 end as bucket from wide)
select range_id, dense_rank() over (order by cluster_id, bucket) as cluster_id from cut""", "bins")
def merge_max_width(v):
    return clusters.merge_windows(v.bins(), 7, max_width=40).select("range_id", "cluster_id")


@query("""select a.range_id, max(b."logCPM") <= max(a."logCPM") as is_max from bins a join bins b on a.chrom = b.chrom and b.start - a."end" <= 60 and a.start - b."end" <= 60 group by a.range_id""", "bins")
def local_maxima(v):
    return clusters.find_maxima(v.bins(), 60, "logCPM").select("range_id", "is_max")


# -- tests -------------------------------------------------------------------------------------------


def bh(table: str, p: str = "p", w: str = "1", out: str = "fdr") -> str:
    """A select that adds adjusted values to a table."""
    return f"""(select * exclude (_raw), least(1, min(_raw) over (order by {p} desc range unbounded preceding)) as {out} from (
        select *, {p} * sum({w}) over () / sum({w}) over (order by {p} range unbounded preceding) as _raw from {table}))"""


def simes_sql(table: str, key: str, p: str = '"PValue"', w: str = "w", row: str = "range_id", name: str = "simes") -> str:
    return f"""{name}_a as (select *, {p} / sum({w}) over (partition by {key} order by {p}, {row} rows unbounded preceding) as _r, row_number() over (partition by {key} order by {p}, {row}) as _n from {table}),
{name}_b as (select *, min(_r) over (partition by {key}) as _m from {name}_a),
{name}_c as (select *, min(case when _r = _m then _n end) over (partition by {key}) as _lead from {name}_b),
{name} as (select {key}, count(*) as n, count(*) filter ("logFC" > 0.5) as up, count(*) filter ("logFC" < -0.5) as down, min(_m) * sum({w}) as p,
    case when bool_or(_n <= _lead and "logFC" > 0) and not bool_or(_n <= _lead and "logFC" < 0) then 'up'
         when bool_or(_n <= _lead and "logFC" < 0) and not bool_or(_n <= _lead and "logFC" > 0) then 'down' else 'mixed' end as direction from {name}_c group by {key})"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


R = "round({0}, 9) as {0}"
P_FDR = ", ".join(R.format(c) for c in ("p", "fdr"))


def clustered(v: Views) -> DataFrame:
    return clusters.merge_windows(v.bins(), 7)


@query(merged("bins", 7) + ", " + simes_sql("ids", "cluster_id") + f"select cluster_id, n, up, down, direction, {P_FDR} from {bh('simes')}", "bins")
def simes(v):
    return rounded(stats.simes(clustered(v), weight="w"), "p", "fdr")


@query(merged("bins", 7) + ", " + simes_sql("ids", "cluster_id", w="1") + f"select cluster_id, n, up, down, direction, {P_FDR} from {bh('simes')}", "bins")
def simes_blocked(v):
    return rounded(stats.simes(clustered(v), blocks=8), "p", "fdr")


@query(merged("bins", 7) + """, best as (select cluster_id, arg_min(range_id, ("PValue" / w, range_id)) as best, least(1, min("PValue" / w) * sum(w)) as p from ids group by cluster_id) """ + f"select cluster_id, best, {P_FDR} from {bh('best')}", "bins")
def best_test(v):
    return rounded(stats.best_test(clustered(v), weight="w"), "p", "fdr")


@query(merged("bins", 7) + """, best as (select cluster_id, arg_min(range_id, (-"logCPM" / w, range_id)) as best, arg_min("PValue", (-"logCPM" / w, range_id)) as p from ids group by cluster_id) """ + f"select cluster_id, best, {P_FDR} from {bh('best')}", "bins")
def best_abundance(v):
    return rounded(stats.best_test(clustered(v), weight="w", cpm="logCPM"), "p", "fdr")


SIDED = ', sided as (select *, case when "logFC" > 0 then "PValue" / 2 else 1 - "PValue" / 2 end as pu, case when "logFC" > 0 then 1 - "PValue" / 2 else "PValue" / 2 end as pd from {0})\n'


def empirical_sql(key: str) -> str:
    return f""", steps as (select u.{key}, u.n, u.up, u.down, u.p, least(1, (select count(*) from d where d.p <= u.p) / (select count(*) from u x where x.p <= u.p)) as e from u)
select {key}, n, up, down, round(p, 9) as p, round(min(e) over (order by p desc range unbounded preceding), 9) as fdr from steps"""


@query(merged("bins", 7) + SIDED.format("ids") + ", " + simes_sql("sided", "cluster_id", "pu", name="u") + ", " + simes_sql("sided", "cluster_id", "pd", name="d") + empirical_sql("cluster_id"), "bins")
def empirical_fdr(v):
    return rounded(stats.empirical_fdr(clustered(v), weight="w"), "p", "fdr")


def mixed_sql(key: str) -> str:
    return f", both_ as (select u.{key}, u.n, u.up, u.down, greatest(u.p, d.p) as p from u join d on u.{key} = d.{key})\nselect {key}, n, up, down, {P_FDR} from {bh('both_')}"


@query(merged("bins", 7) + SIDED.format("ids") + ", " + simes_sql("sided", "cluster_id", "pu", name="u") + ", " + simes_sql("sided", "cluster_id", "pd", name="d") + mixed_sql("cluster_id"), "bins")
def mixed_clusters(v):
    return rounded(stats.mixed_clusters(clustered(v), weight="w"), "p", "fdr")


@query(merged("bins", 7) + """, s as (select range_id, cluster_id, "logCPM" > 8 as summit from ids)
select range_id, case when summit then count(*) over w / sum(summit::int) over w else 1.0 end::double as weight from s window w as (partition by cluster_id)""", "bins")
def summit_weights(v):
    return stats.summit_weights(clustered(v), "cluster_id", F.col("logCPM") > 8).select("range_id", "weight")


# -- regions and their windows -----------------------------------------------------------------------

HITS = '+hits as (select r.region_id, b.* from regions r join bins b on r.chrom = b.chrom and b.start <= r."end" and b."end" >= r.start)\n'


def hits_of(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    tests = v.bins()
    regions = v.regions.select(*REGION_COLUMNS)
    hits = interval_join(tests.select("range_id", "chrom", "start", "end"), regions).select(F.col("r_region_id").alias("region_id"), "range_id")
    return hits, tests, regions


def per_region(body: str) -> str:
    return f", found as ({body})\nselect r.region_id, f.* exclude (region_id) from regions r left join found f on r.region_id = f.region_id"


@query(HITS + ", " + simes_sql("hits", "region_id") + per_region(f"select region_id, n, up, down, direction, {P_FDR} from {bh('simes')}"), "bins", "regions")
def overlap_simes(v):
    return rounded(stats.overlap_simes(*hits_of(v), i_weight="w"), "p", "fdr")


@query(HITS + """, best as (select region_id, arg_min(range_id, ("PValue" / w, range_id)) as best, least(1, min("PValue" / w) * sum(w)) as p from hits group by region_id)""" + per_region(f"select region_id, best, {P_FDR} from {bh('best')}"), "bins", "regions")
def overlap_best(v):
    return rounded(stats.overlap_best(*hits_of(v), i_weight="w"), "p", "fdr")


@query(HITS + SIDED.format("hits") + ", " + simes_sql("sided", "region_id", "pu", name="u") + ", " + simes_sql("sided", "region_id", "pd", name="d") + empirical_sql("region_id").replace("\nselect", ", found as (select", 1) + ")\nselect r.region_id, f.* exclude (region_id) from regions r left join found f on r.region_id = f.region_id", "bins", "regions")
def overlap_empirical(v):
    return rounded(stats.overlap_empirical(*hits_of(v), i_weight="w"), "p", "fdr")


@query(HITS + SIDED.format("hits") + ", " + simes_sql("sided", "region_id", "pu", name="u") + ", " + simes_sql("sided", "region_id", "pd", name="d") + mixed_sql("region_id").replace("\nselect", ", found as (select", 1) + ")\nselect r.region_id, f.* exclude (region_id) from regions r left join found f on r.region_id = f.region_id", "bins", "regions")
def overlap_mixed(v):
    return rounded(stats.overlap_mixed(*hits_of(v), i_weight="w"), "p", "fdr")


@query(HITS + """, best as (select region_id, arg_min(range_id, ("PValue", range_id)) as best from hits group by region_id)
select h.region_id, h.range_id, case when h.range_id = b.best then count(*) over (partition by h.region_id) else 1 end::double as weight from hits h join best b on h.region_id = b.region_id""", "bins", "regions")
def overlap_summit(v):
    hits, tests, regions = hits_of(v)
    return stats.overlap_summits(hits, stats.overlap_best(hits, tests, regions))


# -- cluster FDR -------------------------------------------------------------------------------------


@query(f'select range_id, round(adj, 9) as adj from {bh("bins", chr(34) + "PValue" + chr(34), "w", "adj")}', "bins")
def weighted_bh(v):
    return rounded(adjusted(v.bins(), "PValue", "adj", "w"), "adj").select("range_id", "adj")


@query(merged("bins", 7) + """, sizes as (select cluster_id, sum(w) as size from ids group by cluster_id),
runs as (select sum(size) over (order by size, cluster_id) as run, sum(size) over () * 0.05 as room from sizes)
select round(count(*) filter (run <= room + 1e-9) / count(*), 9) as fdr from runs""", "bins")
def cluster_fdr(v):
    return rounded(clusterfdr.cluster_fdr(clustered(v), 0.05, "w"), "fdr")


def two_sets(v: Views) -> tuple[list[DataFrame], list[DataFrame]]:
    sets = [v.bins(7), v.bins(20)]
    return [s.select("range_id", "chrom", "start", "end") for s in sets], [s.select("range_id", "PValue", "logFC") for s in sets]


BOTH_SETS = '+sets as (select 0 as set_id, * from bins union all select 1, * from bins20)'
POOLED = BOTH_SETS + ",\n" + merged("sets", 3, "set_id, range_id").lstrip("+") + ", even as (select * exclude (w), 1e0 / count(*) over (partition by cluster_id, set_id) as w from ids)\n, "


@query(POOLED + simes_sql("even", "cluster_id", row="set_id, range_id") + f"select cluster_id, n, up, down, direction, {P_FDR} from {bh('simes')}", "bins", "bins20")
def consolidate_sizes(v):
    return rounded(clusterfdr.consolidate_sizes(*two_sets(v), tol=3)[1], "p", "fdr")


@query(BOTH_SETS + """, hits as (select r.region_id as cluster_id, s.* from regions r join sets s on r.chrom = s.chrom and s.start <= r."end" and s."end" >= r.start),
even as (select * exclude (w), 1e0 / count(*) over (partition by cluster_id, set_id) as w from hits)
, """ + simes_sql("even", "cluster_id", row="set_id, range_id") + f"select cluster_id, n, up, down, direction, {P_FDR} from {bh('simes')}", "bins", "bins20", "regions")
def consolidate_regions(v):
    return rounded(clusterfdr.consolidate_sizes(*two_sets(v), regions=v.regions)[1], "p", "fdr")


def searched_sql(table: str, target: float, tol: int, sign: str | None = None, key: str = "range_id", search: clusterfdr.Grid = clusterfdr.Grid()) -> str:
    """CTEs of the threshold search over table(chrom, start, end, adj, w): rounds of a grid, each with its best, and ids(…, cluster_id) of the best threshold."""
    out, centre, half = "", f"(select ln({target} / (1 - {target})) as centre)", search.half_range
    for k in range(search.rounds):
        out += f"""points{k} as materialized (select i, level from (select i, 1 / (1 + exp(-(centre - {half} + i * 2 * {half} / {search.points - 1}))) as level from {centre}, (select unnest(range({search.points})) as i)) where level <= {target} * 1.000001),
chosen{k} as materialized (select t.*, i, level from {table} t join points{k} on adj <= level),
""" + merged(f"chosen{k}", tol, key, "i, chrom", "i, chrom", sign, f"ids{k}").lstrip("+") + f""", sizes{k} as (select i, level, cluster_id, sum(w) as size from ids{k} group by all),
runs{k} as (select i, level, sum(size) over (partition by i order by size, cluster_id) as run, sum(size) over (partition by i) * level as room, size from sizes{k}),
fdrs{k} as (select i, count(*) filter (run <= room + size * 1e-9) / count(*) as fdr from runs{k} group by i),
best{k} as materialized (select arg_max(level, (-abs(coalesce(fdr, 0) - {target}), level)) as level, arg_max(coalesce(fdr, 0), (-abs(coalesce(fdr, 0) - {target}), level)) as fdr from points{k} left join fdrs{k} using (i)),
"""
        centre, half = f"(select ln(level / (1 - level)) as centre from best{k})", half / search.contraction
    return out + f"significant as (select t.* from {table} t, best{search.rounds - 1} where adj <= level),\n" + merged("significant", tol, key, sign=sign).lstrip("+")


EXTENTS = 'select cluster_id, min(chrom) as chrom, min(start)::int as start, max("end")::int as "end", count(*) as n from ids group by cluster_id'


@query(f"""+cubed as (select * exclude (w), pow("PValue", 3) as p3, 1e0 as w, "logFC" > 0 as s from bins),
tested as materialized (select * from {bh("cubed", "p3", "w", "adj")}),
""" + searched_sql("tested", 0.3, 7, "s") + EXTENTS, "bins")
def cluster_windows(v):
    tests = v.bins()
    _, found, _ = clusterfdr.cluster_windows(tests.select("range_id", "chrom", "start", "end"), tests.select("range_id", F.pow("PValue", F.lit(3.0)).alias("PValue"), "logFC"), 0.3, 7, fc="logFC")
    return found


@query(BOTH_SETS + f""", cubed as (select * exclude (w), pow("PValue", 3) as p3, 1e0 / count(*) over (partition by set_id) as w from sets),
tested as materialized (select * from {bh("cubed", "p3", "w", "adj")}),
""" + searched_sql("tested", 0.3, 7, key="set_id, range_id") + EXTENTS, "bins", "bins20")
def consolidate_clusters(v):
    sets, results = two_sets(v)
    results = [r.withColumn("PValue", F.pow("PValue", F.lit(3.0))) for r in results]
    _, found, _ = clusterfdr.consolidate_clusters(sets, results, 0.3, 7)
    return found


@query(BOTH_SETS + f""", cubed as (select * exclude (w), pow("PValue", 3) as p3, 1e0 / count(*) over (partition by set_id) as w from sets),
tested as materialized (select * from {bh("cubed", "p3", "w", "adj")}),
""" + searched_sql("tested", 0.3, 7, key="set_id, range_id") + "select s.set_id, s.range_id, i.cluster_id from sets s left join ids i on s.set_id = i.set_id and s.range_id = i.range_id", "bins", "bins20")
def consolidated_windows(v):
    """The windows of each set with their clusters."""
    sets, results = two_sets(v)
    results = [r.withColumn("PValue", F.pow("PValue", F.lit(3.0))) for r in results]
    return clusterfdr.consolidate_clusters(sets, results, 0.3, 7)[0].select("set_id", "range_id", "cluster_id")


COARSE = clusterfdr.Grid(half_range=6.0, points=9, rounds=3, contraction=2.0)


@query(f"""+cubed as (select * exclude (w), pow("PValue", 3) as p3, 1e0 as w from bins),
tested as materialized (select * from {bh("cubed", "p3", "w", "adj")}),
""" + searched_sql("tested", 0.3, 7, search=COARSE) + "select round(level, 9) as level, round(fdr, 9) as fdr from best2", "bins")
def threshold_search(v):
    """The threshold for a rule of clustering given as a function, on a grid of one's own."""
    rows = adjusted(v.bins().withColumn("p", F.pow("PValue", F.lit(3.0))), "p", "adj")
    found = clusterfdr.control_cluster_fdr(0.3, rows, "adj", lambda chosen, within: clusters.merge_windows(chosen, 7, within=within), batched=False, search=COARSE)
    return rounded(v.spark.createDataFrame([found], "level double, fdr double"), "level", "fdr")


# -- profiles ----------------------------------------------------------------------------------------


def correlation_sql(x: str, y: str) -> str:
    return f"""+ends5 as (select r.chrom, a.length + 1 as t, (flag & 16) > 0 as rev, case when (flag & 16) > 0 then least(a.length + 1, pos + aln_len) else greatest(1, pos) end as p from reads r join axes a on r.chrom = a.chrom),
place as (select chrom, t, p, count(*) filter (not rev) as f, count(*) filter (rev) as r, count(*) as b from ends5 group by all),
delays as (select unnest(range(101)) as d),
pairs_ as (select a.chrom, d, sum(a.{x} * b.{y}) as xy from place a cross join delays join place b on a.chrom = b.chrom and b.p = a.p + d group by all),
sums as (select chrom, t, d, sum(b) as reads, sum({x}) filter (p <= t - d) as x1, sum({x} * {x}) filter (p <= t - d) as x2, sum({y}) filter (p > d) as y1, sum({y} * {y}) filter (p > d) as y2 from place cross join delays group by all),
rhos as (select s.d, reads, ((t - s.d) * coalesce(xy, 0) - x1 * y1)::double / sqrt(((t - s.d) * x2 - x1 * x1)::double) / sqrt(((t - s.d) * y2 - y1 * y1)::double) as rho from sums s left join pairs_ p on s.chrom = p.chrom and s.d = p.d),
profile as (select d::int as delay, round(sum(rho * reads) / sum(reads), 9) as rho from rhos group by d)
"""


@query(correlation_sql("f", "r") + "select * from profile", "reads", "axes")
def cross_correlation(v):
    return rounded(profiles.correlate_reads(v.reads, v.axes, max_dist=100), "rho")


@query(correlation_sql("b", "b") + "select * from profile", "reads", "axes")
def auto_correlation(v):
    return rounded(profiles.correlate_reads(v.reads, v.axes, max_dist=100, cross=False), "rho")


@query(correlation_sql("f", "r") + "select * from profile where delay >= 20 order by rho desc, delay limit 1", "reads", "axes")
def best_delay(v):
    return profiles.best_delay(rounded(profiles.correlate_reads(v.reads, v.axes, max_dist=100), "rho"), 20)


COVERAGE = f"""+frags as ({FRAGS}),
cov as (select r.region_id, o as "offset", count(*) as n from regions r join frags f on r.chrom = f.chrom and f.start <= r.start + 300 and f."end" >= r.start - 300,
    lateral (select unnest(range(greatest(-300, f.start - r.start), least(300, f."end" - r.start) + 1)) as o) group by all),
offsets as (select unnest(range(-300, 301)) as "offset")
"""


@query(COVERAGE + 'select o."offset"::int as "offset", round(coalesce(sum(n), 0) / (select count(*) from regions), 9) as value from offsets o left join cov c on o."offset" = c."offset" group by all', "reads", "axes", "regions")
def site_profile(v):
    return rounded(profiles.site_profile(v.reads, v.axes, v.regions, reach=300), "value")


@query(COVERAGE + ', by_site as (select *, n / sum(n) over (partition by region_id) as s from cov) select o."offset"::int as "offset", round(coalesce(sum(s), 0) / (select count(distinct region_id) from cov), 9) as value from offsets o left join by_site c on o."offset" = c."offset" group by all', "reads", "axes", "regions")
def site_profile_total(v):
    return rounded(profiles.site_profile(v.reads, v.axes, v.regions, reach=300, normalize="total", skip_empty=True), "value")


@query(COVERAGE + ', by_site as (select *, n / max(n) over (partition by region_id) as s from cov) select o."offset"::int as "offset", round(coalesce(sum(s), 0) / (select count(distinct region_id) from cov), 9) as value from offsets o left join by_site c on o."offset" = c."offset" group by all', "reads", "axes", "regions")
def site_profile_max(v):
    return rounded(profiles.site_profile(v.reads, v.axes, v.regions, reach=300, normalize="max", skip_empty=True), "value")


STRANDED_COVERAGE = COVERAGE.replace("join frags f on r.chrom = f.chrom", "join frags f on r.chrom = f.chrom and f.strand = case when r.strand = '-' then '-' else '+' end").replace("regions r join", "(select region_id, chrom, strand, case when strand = '-' then \"end\" else start end as start from regions) r join").replace("select r.region_id, o as", "select r.region_id, case when r.strand = '-' then -o else o end as")


@query(STRANDED_COVERAGE + 'select region_id, "offset"::int as "offset", n::double as value from cov', "reads", "axes", "regions")
def site_profile_stranded(v):
    out = profiles.site_profile(v.reads, v.axes, v.regions, ExtractParams(forward="split"), reach=300, strand="match", average=False)
    return out.filter("value > 0")


@query(COVERAGE + """, p as (select o."offset", round(coalesce(sum(n), 0) / (select count(*) from regions), 9) as v from offsets o left join cov c on o."offset" = c."offset" group by all),
top as (select max(v) as top, arg_min("offset", (-v, "offset")) as "at" from p),
lo as (select coalesce(max("offset"), -301) as lo from p, top where "offset" < top."at" and v < top.top * 0.5), hi as (select coalesce(min("offset"), 301) as hi from p, top where "offset" > top."at" and v < top.top * 0.5)
select greatest(1, hi - lo - 1 - 2 * 100 + 2 - (select median("end" - start + 1) from regions) + 1)::double as width from lo, hi""", "reads", "axes", "regions")
def half_max_width(v):
    profile = rounded(profiles.site_profile(v.reads, v.axes, v.regions, reach=300), "value")
    return profiles.half_max_width(profile, v.regions.select((F.col("end") - F.col("start") + 1).alias("width")), 100)


@query("""+spans as (select r.chrom, (flag & 16) > 0 as rev, side, greatest(1, least(length, case when side = 0 then pos else pos + aln_len - 100 end)) as s, greatest(1, least(length, case when side = 0 then pos + 99 else pos + aln_len - 1 end)) as e
    from reads r join axes a on r.chrom = a.chrom cross join (select unnest([0, 1]) as side)),
base as (select chrom, x, count(*) filter (side = 0 and not rev) as lf, count(*) filter (side = 0 and rev) as lr, count(*) filter (side = 1 and not rev) as rf, count(*) filter (side = 1 and rev) as rr
    from spans, lateral (select unnest(range(s, e + 1)) as x) group by all),
bases as (select region_id, chrom, x from regions, lateral (select unnest(range(start, "end" + 1)) as x))
select b.region_id, round(max(least((coalesce(lf, 0) + 2) / (coalesce(lr, 0) + 2), (coalesce(rr, 0) + 2) / (coalesce(rf, 0) + 2))), 9) as score from bases b left join base s on b.chrom = s.chrom and b.x = s.x group by all""", "reads", "axes", "regions")
def bimodality(v):
    return rounded(profiles.bimodality(v.reads, v.axes, v.regions.select(*REGION_COLUMNS)), "score")


# -- abundance and normalisation ---------------------------------------------------------------------


def abundance_sql(name: str, source: str, scale: str = "1.0", prior: str = "2.0") -> str:
    """CTEs of an independent fit: name(source's columns, abundance) from lists y of counts and s of library sizes, by Newton's steps on the likelihood."""
    mu = "exp(b + o[j])"
    slope, curve = (f"list_sum(list_transform(range(1, len(z) + 1), lambda j: {x} / (1 + 0.05 * {mu})))" for x in (f"(z[j] - {mu})", mu))
    return f"""{name}_a as materialized (select *, {scale} as _scale, list_transform(range(1, len(y) + 1), lambda j: y[j] + {scale} * {prior} * s[j] / list_avg(s)) as z, list_transform(s, lambda x: ln(x + 2 * {prior} * x / list_avg(s))) as o from {source}),
{name}_b as (select *, case when list_sum(z) > 0 then list_reduce([ln(list_sum(z) / list_sum(list_transform(o, lambda x: exp(x))))] || list_transform(range(30), lambda i: 0e0), lambda b, i: b + {slope} / {curve}) end as beta from {name}_a),
{name} as (select * exclude (z, o, beta, _scale), (beta - ln(_scale) + ln(1e6)) / ln(2) as abundance from {name}_b)"""


def matrix_sql(name: str, ranges: str, hits: str, on: str, keys: str, libs: str = "libs") -> str:
    """A CTE name(keys, y, s): lists of the counts of hits and of library sizes for each of ranges."""
    columns = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""{name} as (select {keys}, list(n order by library) as y, list(size order by library) as s from (
    select {columns}, l.library, l.size, count(h.library)::double as n from {ranges} r cross join {libs} l left join {hits} h on h.library = l.library and {on} group by all) group by {keys})"""


LIBS = "libs as (select library, count(*)::double as size from reads group by library)"
READ_LENGTH = "(select floor(avg(l))::int from (select round_even(avg(aln_len), 0) as l from reads group by library))"
KEPT_WINDOWS = WINDOWS + f""", {LIBS}, kept as (select chrom, k, start, "end" from hits group by all having count(*) >= 10),
""" + matrix_sql("m", "kept", "hits", "h.chrom = r.chrom and h.k = r.k", 'chrom, k, start, "end"')
REGION_HIT = 'h.chrom = r.chrom and h.start <= r."end" and h."end" >= r.start'
REGION_MATRIX = f"+frags as ({FRAGS}), {LIBS},\n" + matrix_sql("m", "regions", "frags", REGION_HIT, 'region_id, start, "end"')


def counted_regions(v: Views, ext=100):
    return tiles.region_counts(v.reads, v.axes, v.regions.select(*REGION_COLUMNS), ext=ext)


@query('select region_id, "end" - start + 1 + (select cast(avg(l) as int) from (select round_even(avg(aln_len), 0) as l from reads group by library)) - 1 as width from regions', "reads", "regions")
def effective_widths(v):
    data = counted_regions(v)
    return data.ranges().select("region_id", abundance.effective_width(F.col("start"), F.col("end"), abundance.fragment_length(data)).alias("width"))


@query('select sum(ceil(length / 50))::bigint as windows from axes', "axes")
def genome_windows(v):
    return v.spark.createDataFrame([(abundance.genome_windows(v.axes, 50),)], "windows bigint")


@query(REGION_MATRIX + ", " + abundance_sql("found", "m") + "\nselect region_id, round(abundance, 9) as abundance from found", "reads", "axes", "regions")
def scaled_average(v):
    data = counted_regions(v)
    names, sizes = abundance.library_sizes(data)
    return rounded(abundance.scaled_average(data.matrix(names), sizes), "abundance").select("region_id", "abundance")


@query(KEPT_WINDOWS + ", " + abundance_sql("found", "m") + """, g as (select sum(ceil(length / 50)) as genome from axes),
ranked as (select *, rank() over (order by round(abundance, 9)) + (count(*) over (partition by round(abundance, 9)) - 1) / 2 as r, count(*) over () as n from found)
select chrom, k, round(case when genome <= n then r / n else 1 + (r - n) / genome end, 9) as filter from ranked, g""", "reads", "axes")
def proportion_filter(v):
    return rounded(abundance.filter_proportion(tiles.window_counts(v.reads, v.axes, least=10, **SLIDING), v.axes), "filter").select("chrom", "k", "filter")


@query(KEPT_WINDOWS + """, fives as (select r.library, r.chrom, a.length, greatest(1, least(a.length, case when (r.flag & 16) > 0 then r.pos + r.aln_len - 1 else r.pos end)) as p from reads r join axes a on r.chrom = a.chrom),
places as (select library, chrom, (p - 1) // 1000 as k, length from fives), wide as (select distinct chrom, k, k * 1000 + 1 as start, least(length, k * 1000 + 1000) as "end" from places),
""" + matrix_sql("w", "wide", "places", "h.chrom = r.chrom and h.k = r.k", 'chrom, k, start, "end"') + f""",
ratios as (select (select median("end" - start + 1) from wide) / (select median("end" - start + {READ_LENGTH}) from kept) as ratio), wr as (select * from w, ratios),
""" + abundance_sql("found", "m") + ", " + abundance_sql("back", "wr", "ratio") + """,
ordered as (select abundance, row_number() over (order by abundance) - 1 as pos, count(*) over () as n from back),
level as (select sum(abundance * greatest(0, 1 - abs((1 - 0.5 / least(1, n / genome)) * (n - 1) - pos))) as level from ordered, (select sum(ceil(length / 1000)) as genome from axes))
select chrom, k, round(abundance - level, 9) as filter from found, level""", "reads", "axes")
def global_filter(v):
    data = tiles.window_counts(v.reads, v.axes, least=10, **SLIDING)
    return rounded(abundance.filter_global(data, v.axes, tiles.window_counts(v.reads, v.axes, width=1000, bins=True)), "filter").select("chrom", "k", "filter")


@query(REGION_MATRIX + """, wide as (select region_id, chrom, greatest(1, start - 1000) as start, "end" + 1000 as "end" from regions),
""" + matrix_sql("w", "wide", "frags", REGION_HIT, 'region_id, start, "end"') + f""",
rest as (select region_id, list_transform(range(1, len(m.y) + 1), lambda j: greatest(0, w.y[j] - m.y[j])) as y, m.s, (w."end" - w.start - m."end" + m.start) / (m."end" - m.start + {READ_LENGTH}) as ratio from m join w using (region_id)),
""" + abundance_sql("found", "m") + ", " + abundance_sql("back", "rest", "ratio") + "\nselect region_id, round(f.abundance - b.abundance, 9) as filter from found f join back b using (region_id)", "reads", "axes", "regions")
def local_filter(v):
    wide = v.regions.select("region_id", "chrom", F.greatest(F.lit(1), F.col("start") - 1000).alias("start"), (F.col("end") + 1000).alias("end"))
    return rounded(abundance.filter_local(counted_regions(v), tiles.region_counts(v.reads, v.axes, wide)), "filter").select("region_id", "filter")


@query(f"""+frags as ({FRAGS}), {LIBS}, own as (select * from libs where library = 'lib0'), others as (select * from libs where library <> 'lib0'),
fives as (select r.library, r.chrom, greatest(1, least(a.length, case when (r.flag & 16) > 0 then r.pos + r.aln_len - 1 else r.pos end)) as p from reads r join axes a on r.chrom = a.chrom),
places as (select library, chrom, (p - 1) // 5000 as k from fives), wide as (select chrom, unnest(range(ceil(length / 5000)::bigint)) as k from axes),
lengths as (select floor(avg(l) filter (library = 'lib0'))::int as own, floor(avg(l) filter (library <> 'lib0'))::int as others from (select library, round_even(avg(aln_len), 0) as l from reads group by library)),
""" + ",\n".join([matrix_sql("bo", "wide", "places", "h.chrom = r.chrom and h.k = r.k", "chrom, k", "own"), matrix_sql("bc", "wide", "places", "h.chrom = r.chrom and h.k = r.k", "chrom, k", "others"),
    abundance_sql("fo", "bo", prior="0.0"), abundance_sql("fc", "bc", prior="0.0"),
    "norms as (select pow(2, -coalesce(median(fo.abundance - fc.abundance), 0)) as norm from fo join fc using (chrom, k))", "scaled as (select library, size * norm as size from others, norms)",
    matrix_sql("mo", "regions", "frags", REGION_HIT, 'region_id, start, "end"', "own"), matrix_sql("mc", "regions", "frags", REGION_HIT, 'region_id, start, "end"', "scaled"),
    'md as (select mc.*, (\"end\" - start + others) / (\"end\" - start + own) as ratio, 2 * list_avg(s) / (select size from own) as share from mc, lengths)',
    abundance_sql("found", "mo"), abundance_sql("back", "md", "ratio", "share")]) + "\nselect region_id, round(f.abundance - b.abundance, 9) as filter from found f join back b using (region_id)", "reads", "axes", "regions")
def control_filter(v):
    place = v.regions.select(*REGION_COLUMNS)
    split = lambda own: v.reads.filter((F.col("library") == "lib0") == own)
    sets = [tiles.region_counts(split(own), v.axes, place) for own in (True, False)]
    bins = tuple(tiles.window_counts(split(own), v.axes, width=5000, bins=True, least=0) for own in (True, False))
    return rounded(abundance.filter_control(sets[0], sets[1], bins), "filter").select("region_id", "filter")


COUNTED = f"""+frags as ({FRAGS}), libs as (select library, count(*)::double as size from reads group by library),
counts as (select r.region_id, l.library, l.size, count(f.library)::double as n from regions r cross join libs l left join frags f on f.library = l.library and f.chrom = r.chrom and f.start <= r."end" and f."end" >= r.start group by all),
y as (select * from counts where region_id in (select region_id from counts group by region_id having sum(n) > 0))
"""
GEOMETRIC = "select library, round(f / exp(avg(ln(f)) over ()), 9) as norm_factor from factors"


@query(COUNTED + """, q as (select library, quantile_cont(n / size, 0.75) as q from y group by library),
ref as (select arg_min(library, (abs(q - m), library)) as ref from q, (select avg(q) as m from q)),
r as (select region_id, n as rn, size as rs from y, ref where library = ref),
v as (select library, round(log2(n / size) - log2(rn / rs), 12) as m, round((log2(n / size) + log2(rn / rs)) / 2, 12) as a from y join r using (region_id) where n > 0 and rn > 0),
k as (select *, count(*) over w as c, rank() over (partition by library order by m) + (count(*) over (partition by library, m) - 1) / 2 as rm, rank() over (partition by library order by a) + (count(*) over (partition by library, a) - 1) / 2 as ra, max(abs(m)) over w as most from v window w as (partition by library)),
factors as (select library, case when max(most) < 1e-6 then 1 else pow(2, avg(m) filter (rm between floor(c * 0.3) + 1 and c - floor(c * 0.3) and ra between floor(c * 0.05) + 1 and c - floor(c * 0.05))) end as f from k group by library)
""" + GEOMETRIC, "reads", "axes", "regions")
def tmm_factors(v):
    return rounded(normalise.norm_offsets(counted_regions(v)), "norm_factor")


@query(COUNTED + ", factors as (select library, quantile_cont(n / size, 0.75) as f from y group by library) " + GEOMETRIC, "reads", "axes", "regions")
def upper_quartile_factors(v):
    return rounded(normalise.norm_offsets(counted_regions(v), method="upperquartile"), "norm_factor")


@query(COUNTED + ", g as (select region_id, exp(avg(ln(greatest(n, 1)))) as gm from y group by region_id having min(n) > 0), factors as (select library, quantile_cont(n / gm, 0.5) / any_value(size) as f from y join g using (region_id) group by library) " + GEOMETRIC, "reads", "axes", "regions")
def rle_factors(v):
    return rounded(normalise.norm_offsets(counted_regions(v), method="RLE"), "norm_factor")


NORMALISED = COUNTED + ", factors as (select library, quantile_cont(n / size, 0.75) as f from y group by library), norms as (" + GEOMETRIC + ")\n"


@query(NORMALISED + "select l.library, l.size::bigint as total, norm_factor from libs l join norms n on l.library = n.library", "reads", "axes", "regions")
def normalised_libraries(v):
    return rounded(normalise.normalize(counted_regions(v), method="upperquartile").libraries.select("library", "total", "norm_factor"), "norm_factor")


@query(NORMALISED + "select l.library, l.size as lib_size, norm_factor from libs l join norms n on l.library = n.library", "reads", "axes", "regions")
def model_samples(v):
    return rounded(normalise.model_tables(normalise.normalize(counted_regions(v), method="upperquartile"))[1], "norm_factor")


def trend_sql(points: str, round_: int) -> str:
    """CTEs of one round of a local fit at the knots of reach: trend_{round_}(columns of points, trend) and weighed_{round_}, its points weighed anew."""
    r = round_
    return f"""kernel_{r} as (select library, p, h, sum(k * u) / sum(k) as mu, sum(k * u * u) / sum(k) as muu, sum(k * y) / sum(k) as my, sum(k * u * y) / sum(k) as muy from (
    select library, p, h, (x - p) / h as u, y, w * pow(greatest(0, 1 - pow(abs(x - p) / h, 3)), 3) as k from {points}, reach) group by all having sum(k) > 0),
value_{r} as (select library, p, case when muu - mu * mu > 0 and sqrt(muu - mu * mu) * h > 0.001 * (select max(p) - min(p) from reach) then my - (muy - mu * my) / (muu - mu * mu) * mu else my end as v from kernel_{r}),
line_{r} as (select *, lead(p) over (partition by library order by p) as p2, lead(v) over (partition by library order by p) as v2 from value_{r}),
trend_{r} as materialized (select a.*, v + coalesce((v2 - v) * (x - p) / (p2 - p), 0) as trend from {points} a asof join line_{r} l on a.library = l.library and a.x >= l.p),
weighed_{r} as materialized (select region_id, library, x, y, case when 6 * m < 1e-12 then w else pow(greatest(0, 1 - pow(abs(y - trend) / (6 * m), 2)), 2) end as w from trend_{r} join (select library, median(abs(y - trend)) as m from trend_{r} group by library) using (library))"""


@query(REGION_MATRIX + ", " + abundance_sql("found", "m", prior="0.5") + """,
xs as materialized (select region_id, y as ys, s, round(abundance * ln(2), 9) as x from found),
points as materialized (select region_id, library, x, ln(ys[i] + 0.5 * s[i] / list_avg(s)) as y, 1e0 as w from xs, (select library, row_number() over (order by library) as i from libs)),
sorted as materialized (select x, row_number() over (order by x) - 1 as r, count(*) over () as n from xs),
spots as (select i * (n - 1) / greatest(1, least(n, 200) - 1) as q from (select n from sorted limit 1), range(200) t(i) where i < least(n, 200)),
knots as materialized (select distinct a.x + (b.x - a.x) * (q - floor(q)) as p from spots join sorted a on a.r = floor(q) join sorted b on b.r = ceil(q)),
reach as materialized (select p, greatest(1e-10, max(d)) as h from (select p, n, abs(x - p) as d, row_number() over (partition by p order by abs(x - p)) as k from knots, sorted) where k <= least(n, greatest(2, ceil(0.3 * n))) group by p),
""" + ",\n".join(trend_sql("points" if r == 0 else f"weighed_{r - 1}", r) for r in range(4)) + """
select region_id, library, round(trend - avg(trend) over (partition by region_id), 7) + 0e0 as "offset" from trend_3""", "reads", "axes", "regions")
def loess_offsets(v):
    found = normalise.norm_offsets(counted_regions(v), "loess")
    return found.select("region_id", "library", (F.round("offset", 7) + F.lit(0.0)).alias("offset"))


@query(COUNTED + "select region_id, sum(n) filter (library = 'lib0')::bigint as lib0, sum(n) filter (library = 'lib1')::bigint as lib1, sum(n) filter (library = 'lib2')::bigint as lib2 from counts group by region_id", "reads", "axes", "regions")
def model_table(v):
    return normalise.model_tables(counted_regions(v))[0].select("region_id", "lib0", "lib1", "lib2")


# -- annotation --------------------------------------------------------------------------------------

FEATURES = """+prom as (select gene_id, t.chrom, strand, greatest(1, case when strand = '+' then tx_start - 300 else tx_end - 99 end) as start, least(length, case when strand = '+' then tx_start + 99 else tx_end + 300 end) as "end" from transcripts t join axes a on t.chrom = a.chrom),
parts as (select gene_id, chrom, strand, start, "end", false as prom from exons union all select gene_id, chrom, strand, start, "end", true from prom where start <= "end"),
gaps as (select *, case when start - lag("end") over (partition by gene_id, chrom, strand order by start, "end", prom) - 1 > 150 then 1 else 0 end as new from parts),
cut as (select *, sum(new) over (partition by gene_id, chrom, strand order by start, "end", prom rows unbounded preceding) as part from gaps),
named as (select *, dense_rank() over (order by gene_id, chrom, strand, part) as internal from cut),
numbered as (select internal, gene_id, chrom, strand, start, "end", case when prom then 0 when strand = '+' then row_number() over (partition by internal, prom order by start, "end") else row_number() over (partition by internal, prom order by "end" desc, start desc) end as exon from named),
everything as (select * from numbered union all select internal, gene_id, chrom, strand, min(start), max("end"), -1 from named where not prom group by all),
features as (select e.internal, e.gene_id, coalesce(s.symbol, '<' || e.gene_id || '>') as symbol, e.chrom, e.start::int as start, e."end"::int as "end", e.strand, e.exon::int as exon from everything e left join (select gene_id, min(symbol) as symbol from symbols group by gene_id) s on e.gene_id = s.gene_id)
"""


def features_of(v: Views) -> DataFrame:
    return annotate.gene_features(v.exons, v.transcripts, v.symbols, v.axes, (300, 100), 150)


@query(FEATURES + "select * from features", "transcripts", "symbols", "axes")
def gene_features(v):
    return features_of(v)


ANNOTATED = """, touching as (
    select region_id, 'overlap' as mode, f.*, null as d from regions r join features f on r.chrom = f.chrom and f.start <= r."end" and f."end" >= r.start
    union all select region_id, 'left', f.*, r.start - f."end" from regions r join features f on r.chrom = f.chrom and f.exon > 0 and r.start - f."end" between 1 and 400
    union all select region_id, 'right', f.*, f.start - r."end" from regions r join features f on r.chrom = f.chrom and f.exon > 0 and f.start - r."end" between 1 and 400),
runs as (select region_id, mode, internal, symbol, strand, exon, exon - row_number() over (partition by region_id, mode, internal order by exon) as island from (select distinct region_id, mode, internal, symbol, strand, exon from touching where exon >= 0)),
texts as (select region_id, mode, internal, case when min(exon) = max(exon) then min(exon)::varchar else min(exon) || '-' || max(exon) end as t, min(exon) as at from runs group by region_id, mode, internal, island),
genes as (select t.region_id, t.mode, t.internal, t.symbol || '|' || coalesce((select string_agg(x.t, ',' order by x.at) from texts x where x.region_id = t.region_id and x.mode = t.mode and x.internal = t.internal), 'I') || '|' || t.strand || case when min(d) is null then '' else '[' || min(d) || ']' end as g
    from touching t group by t.region_id, t.mode, t.internal, t.symbol, t.strand)
select r.region_id, coalesce(string_agg(g, ',' order by internal) filter (mode = 'overlap'), '') as overlap, coalesce(string_agg(g, ',' order by internal) filter (mode = 'left'), '') as "left", coalesce(string_agg(g, ',' order by internal) filter (mode = 'right'), '') as "right"
from regions r left join genes g on r.region_id = g.region_id group by r.region_id"""


@query(FEATURES + ANNOTATED, "transcripts", "symbols", "axes", "regions")
def annotate_regions(v):
    return annotate.annotate_regions(v.regions.select(*REGION_COLUMNS), features_of(v), 400)


@query(FEATURES + ANNOTATED.replace("on r.chrom = f.chrom", "on r.chrom = f.chrom and (r.strand = f.strand or r.strand = '*')"), "transcripts", "symbols", "axes", "regions")
def annotate_stranded(v):
    return annotate.annotate_regions(v.regions.select(*REGION_COLUMNS, "strand"), features_of(v), 400, ignore_strand=False)
