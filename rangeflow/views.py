"""Interval tables derived from the driver's events and part tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import tiles
from .params import ExtractParams

_LENGTH = "(select cast(greatest(20000, 2 * count(*)) as int) from {events})"
_AXIS5 = "concat('chr', substr('CEPSV', cast({0} % 5 as int) + 1, 1))"

SQL = {
    "axes": f"select distinct concat('chr', upper(substr(event_type, 1, 1))) as chrom, {_LENGTH} as length from {{events}}",
    "reads": f"""select event_id as read_id, concat('lib', event_id % 3) as library, concat('q', event_id) as qname,
        cast(case when (event_id * 31 + user_id * 17) % 2 = 1 then 16 else 0 end + case when event_id % 5 = 0 then 1024 else 0 end as int) as flag,
        concat('chr', upper(substr(event_type, 1, 1))) as chrom,
        cast((event_id * 7919 + user_id * 104729) % {_LENGTH} + 1 as int) as pos,
        cast((event_id * 37) % 60 as int) as mapq, cast(20 + event_id % 31 as int) as aln_len,
        cast(null as string) as mate_chrom, cast(null as int) as mate_pos from {{events}}""",
    "ends": f"""select event_id, event_id - event_id % 2 as pair, event_id % 2 as second, upper(substr(event_type, 1, 1)) as letter,
        (event_id * 7919 + user_id * 104729) % {_LENGTH} + 1 as p, (event_id * 31 + user_id * 17) % 2 as rev from {{events}}""",
    "regions": f"""select p_partkey as region_id, {_AXIS5.format("p_partkey")} as chrom,
        cast((p_partkey * 6151) % {_LENGTH} + 1 as int) as start,
        cast(least({_LENGTH}, (p_partkey * 6151) % {_LENGTH} + 101 + p_partkey % 400) as int) as "end",
        substr('+-*', cast(p_partkey % 3 as int) + 1, 1) as strand from {{part}}""",
    "discard": f"""select {_AXIS5.format("p_partkey")} as chrom, cast((p_partkey * 7727) % {_LENGTH} + 1 as int) as start,
        cast((p_partkey * 7727) % {_LENGTH} + 21 + p_partkey % 40 as int) as "end" from {{part}}""",
    "exons": f"""select concat('g', (p_partkey - p_partkey % 4)) as gene_id, {_AXIS5.format("((p_partkey - p_partkey % 4) * 3)")} as chrom,
        cast(((p_partkey - p_partkey % 4) * 7727) % {_LENGTH} + (p_partkey % 4) * 300 + 1 as int) as start,
        cast(((p_partkey - p_partkey % 4) * 7727) % {_LENGTH} + (p_partkey % 4) * 300 + 101 + p_partkey % 57 as int) as "end",
        case when ((p_partkey - p_partkey % 4) * 5) % 3 = 0 then '+' else '-' end as strand from {{part}}""",
    "symbols": "select concat('g', (p_partkey - p_partkey % 4)) as gene_id, concat(p_name, '_', p_partkey) as symbol from {part} where p_size >= 40",
}
#: Mates: the odd event of a pair stands near the even one's place, on its own axis for each seventh pair; each eleventh pair is two single reads.
SQL["pairs"] = f"""select concat('lib', a.pair % 3) as library, concat('p', a.pair) as qname,
        cast(case when a.pair % 11 = 0 then 0 else 1 + case when b.event_id is null then 8 else case when b.rev = 1 then 32 else 0 end end
             + case when a.second = 0 then 64 else 128 end end + 16 * a.rev + case when a.event_id % 5 = 0 then 1024 else 0 end as int) as flag,
        concat('chr', a.letter) as chrom, cast(a.place as int) as pos, cast((a.event_id * 37) % 60 as int) as mapq, cast(20 + a.event_id % 31 as int) as aln_len,
        case when a.pair % 11 <> 0 then concat('chr', b.letter) end as mate_chrom, case when a.pair % 11 <> 0 then cast(b.place as int) end as mate_pos
        from {{placed}} a left join {{placed}} b on a.pair = b.pair and a.second <> b.second"""
SQL["placed"] = f"""select e.event_id, e.pair, e.second, e.rev, case when e.pair % 7 = 0 then e.letter else coalesce(f.letter, e.letter) end as letter,
        case when e.second = 0 then e.p else greatest(1, least({_LENGTH}, coalesce(f.p, e.p) + (e.pair * 37) % 600 - 100)) end as place
        from {{ends}} e left join {{ends}} f on e.pair = f.pair and f.second = 0"""
#: Statistics of a window with index k on an axis, from integer hashes.
TESTS = {
    "PValue": "((k * 7919 + ascii(substr(chrom, 4, 1)) * 104729 + 13) % 9973 + 1) / 9974e0",
    "logFC": "((k * 31 + ascii(substr(chrom, 4, 1)) * 7) % 401 - 200) / 100e0",
    "logCPM": "((k * 53 + ascii(substr(chrom, 4, 1))) % 1000) / 100e0",
    "w": "cast(1 + k % 4 as double)",
    "range_id": "cast(ascii(substr(chrom, 4, 1)) * 10000000 + k as bigint)",
}


class Views:
    """The derived tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, name: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(SQL[name].replace('"end"', "`end`"), events=self._table("events"), part=self._table("part"), **frames)

    @cached_property
    def axes(self) -> DataFrame:
        return self._sql("axes")

    @cached_property
    def reads(self) -> DataFrame:
        return self._sql("reads")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._sql("pairs", placed=self._sql("placed", ends=self._sql("ends")))

    @cached_property
    def regions(self) -> DataFrame:
        return self._sql("regions")

    @cached_property
    def discard(self) -> DataFrame:
        return self._sql("discard")

    @cached_property
    def exons(self) -> DataFrame:
        return self._sql("exons")

    @cached_property
    def transcripts(self) -> DataFrame:
        return self.exons.groupBy("gene_id", "chrom", "strand").agg(F.min("start").alias("tx_start"), F.max("end").alias("tx_end"))

    @cached_property
    def symbols(self) -> DataFrame:
        return self._sql("symbols")

    def bins(self, width: int = 7) -> DataFrame:
        """Occupied bins of all reads with synthetic statistics: range_id, chrom, k, start, end, PValue, logFC, logCPM, w."""
        counted = tiles.window_counts(self.reads, self.axes, ExtractParams(), width=width, bins=True)
        rows = counted.counts.select("chrom", "k", "start", "end").distinct()
        return rows.withColumns({name: F.expr(sql) for name, sql in TESTS.items()})


def oracle(body: str, *views: str) -> str:
    """body as DuckDB SQL with the named derived views, and those they need, as common table expressions."""
    needs = {"pairs": ("ends", "placed"), "transcripts": ("exons",), "bins": ("axes", "reads", "fives")}
    order = ["axes", "reads", "ends", "placed", "pairs", "regions", "discard", "exons", "transcripts", "symbols", "fives", "bins", "bins20"]
    if "bins20" in views:
        views = (*views, "bins")
    wanted = set(views) | {n for v in views for n in needs.get(v, ())}
    texts = SQL | {
        "transcripts": 'select gene_id, chrom, strand, min(start) as tx_start, max("end") as tx_end from exons group by all',
        "fives": "select r.library, r.chrom, a.length, greatest(1, least(a.length, case when (r.flag & 16) > 0 then r.pos + r.aln_len - 1 else r.pos end)) as p from reads r join axes a on r.chrom = a.chrom",
    }
    for name, width in (("bins", 7), ("bins20", 20)):
        columns = ", ".join(f"{sql} as {c}" for c, sql in TESTS.items())
        texts[name] = f'select chrom, k, k * {width} + 1 as start, least(length, k * {width} + {width}) as "end", {columns} from (select distinct chrom, length, (p - 1) // {width} as k from fives)'
    names = {n: n for n in ("events", "part", "ends", "placed")}
    ctes = ",\n".join(f"{v} as ({texts[v].format(**names)})" for v in order if v in wanted)
    return f"with {ctes}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().removeprefix('+')}"
