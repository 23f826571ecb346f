"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Every document of the source is first allocated the certain
whole copies, floor(target / source size). The remaining fraction is the share of the source's words
that is drawn besides, and the mean inclusion probability of a word. A document's own probability p
leans from it by its length: with f = size / (size + the source's mean size), in steps of 1 / LEAN, it
is share + min(share, 1 - share) * (mean of f over words - f). So long documents are less likely and a
draw holds more different documents, while the expected words stay those wanted. Documents are then
ranked by their random odds divided by their inclusion odds, (u / (1 - u)) / (p / (1 - p)), with u a
reproducible hash of the document, and taken in that order while their words fit. The sample's size
is fixed in words: one more document, the one whose size is nearest to what is left, is taken if that
brings the sum nearer to the target.

No source is sorted as a whole: a histogram over the ranking variable finds the bucket in which the
target is reached, and only that bucket's documents are ordered.

Defined cases: a null or blank text has size 0 and takes 0; the null source is one source, last in
order; rows with one id (or none) share one random number, ties end by size; of rows equal in all of
these as many are taken as fit, whichever they are; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, unit_hash

#: Weights by a source's place in code-point order, the mix's size, most copies.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
SEED = "pareto-mix"
#: Steps in which probabilities lean by length, so that their sums are exact integers.
LEAN = 1024
#: The order in which documents are drawn.
KEY = ("place", "doc_id", "size")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sizes(source, size) to (source, source_size, target): a row for each source.

    Targets share share x all words by weight, none above most x its source's words. With sources
    ordered by cap / weight the capped ones come first; the level is the fair share of the remainder
    at the first source that stays within its own cap, from where on the shares only fall.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    choice = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    # windows over one row for each source
    return sizes.sparkSession.sql(f"""
        with ranked as (
            select *, case (row_number() over (order by source is null, source) - 1) % {len(weights)} {choice} end as weight
            from {{sums}}),
        filled as (
            select *, sum({most} * source_size) over w - {most} * source_size as capped_before,
                   sum(weight) over () - sum(weight) over w + weight as weight_left,
                   {share} * sum(source_size) over () as total
            from ranked
            window w as (order by {most} * source_size / weight, source is null, source rows unbounded preceding)),
        levels as (
            select *, cast(total - capped_before as double) / weight_left as level,
                   cast({most} * source_size as double) / weight as own from filled),
        chosen as (
            select *, max(case when level <= own then level end) over () as final from levels)
        select source, source_size, documents,
               case when own <= coalesce(final, own) then cast({most} * source_size as double) else final * weight end as target
        from chosen""", sums=sums)


def _leant(share: str, lean: Column) -> Column:
    """A document's inclusion probability from its source's share and its own length."""
    room = F.least(F.col(share), 1 - F.col(share))
    return F.col(share) + room * (F.col("s.leaning") / (LEAN * F.col("s.source_size")) - lean / LEAN)


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) for every row of docs.

    row is row_col, a number that differs from row to row, or else a number given here.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    save = scratch.stored
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    rows = save(docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")
    sources = source_targets(rows, weights, share, most)
    sources = sources.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    sources = sources.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole"))
    sources = sources.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = sources.withColumn("mean", F.greatest(F.lit(1).cast("bigint"), F.expr("source_size div documents")))
    sources = save(sources, "sources")
    lean = F.expr(f"{LEAN} * r.size div (r.size + s.mean)")
    leaning = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(F.sum(F.col("r.size") * lean).alias("leaning"))
    sources = save(sources.alias("s").join(leaning.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source"))).select("s.*", "l.leaning"), "leanings")
    most_docs = sources.agg(F.max("documents")).first()[0] or 1
    buckets = 1 << min(20, max(4, math.ceil(math.log2(max(1, most_docs) / 500 + 1))))
    u = unit_hash(F.col("doc_id"), seed=seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.row", "r.doc_id", "r.source", "r.size", "s.source_size", "s.target", "s.whole", "s.goal", F.when(F.col("s.p") > 0, _leant("s.p", lean)).otherwise(F.lit(0.0)).alias("p"))
    # odds in (0, inf) to a place in (0, 1); nothing is drawn where p is 0
    ranked = ranked.withColumn("place", F.when(F.col("p") > 0, odds / (1 + odds)))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)))
    drawn = ranked.filter("p > 0")
    # the bucket in which the running sum passes the goal
    hist = drawn.groupBy("source", "bucket", "goal").agg(F.sum("size").alias("words"))
    hist = hist.withColumn("upto", F.expr("sum(words) over (partition by source order by bucket rows unbounded preceding)"))
    cut = hist.filter("upto > goal").groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before"))
    cut = save(cut, "cut")
    edge = drawn.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.bucket") == F.col("c.cut"))).select("d.*", "c.before")
    # rows with an equal key are one step of the order, however many there are
    edge = edge.groupBy("source", "goal", "before", *KEY).agg(F.count("*").alias("n"))
    edge = edge.withColumn("run", F.expr("before + sum(size * n) over (partition by source order by place, doc_id, size rows unbounded preceding)"))
    # the first key whose rows no longer all fit ends the order
    stop = F.struct(*KEY)
    last = edge.filter("run > goal").groupBy("source", "goal").agg(F.min(stop).alias("stop"), F.min_by(F.col("run") - F.col("size") * F.col("n"), stop).alias("sum"))
    last = last.withColumn("fits", F.floor((F.col("goal") - F.col("sum")) / F.col("stop.size")))
    last = save(last.withColumn("left", F.col("goal") - F.col("sum") - F.col("fits") * F.col("stop.size")).drop("goal"), "last")
    joined = ranked.alias("d").join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")), "left").select("d.*", "l.stop", "l.fits", "l.left")
    joined = joined.withColumn("inside", (F.col("p") > 0) & (F.col("stop").isNull() | (F.struct(*KEY) < F.col("stop"))))
    gain = F.col("left") - F.abs(F.col("left") - F.col("size"))
    outside = joined.filter("p > 0 and stop is not null and not inside").filter(gain > 0)
    filler = outside.groupBy("source").agg(F.min(F.struct((-gain).alias("g"), *KEY)).alias("filler")).select("source", *[F.col(f"filler.{c}").alias(c) for c in KEY], F.lit(1).cast("bigint").alias("take"))
    # at most two keys of each source of which only some rows are taken
    partly = last.select("source", *[F.col(f"stop.{c}").alias(c) for c in KEY], F.col("fits").alias("take")).unionByName(filler)
    partly = save(partly.groupBy("source", *KEY).agg(F.sum("take").alias("take")), "partly")
    same = F.col("d.source").eqNullSafe(F.col("t.source")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.place") == F.col("t.place")) & (F.col("d.size") == F.col("t.size"))
    marked = joined.alias("d").join(partly.alias("t"), same, "left").select("d.*", "t.take")
    tied = marked.filter("take is not null").withColumn("block", F.shiftright("row", 33))
    # their rows are numbered within blocks, and the blocks' sizes summed up
    upto = save(tied.groupBy("source", *KEY, "block").agg(F.count("*").alias("n")), "tied").withColumn("upto", F.expr("sum(n) over (partition by source, place, doc_id, size order by block) - n"))
    upto = save(upto.select("source", *KEY, "block", "upto"), "tied-blocks")
    tied = tied.withColumn("number", F.expr("row_number() over (partition by source, place, doc_id, size, block order by row)"))
    same = same & (F.col("d.block") == F.col("t.block"))
    tied = tied.alias("d").join(upto.alias("t"), same).select("d.*", "t.upto").withColumn("inside", F.col("number") + F.col("upto") <= F.col("take"))
    columns = ["row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.when(F.col("inside"), 1).otherwise(0)).cast("int").alias("copies")]
    scratch.clear("sizes", "leanings", "last", "partly", "tied-blocks")
    return marked.filter("take is null").select(*columns).unionByName(tied.select(*columns))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return out.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


OP3_SQL = f"""
with sized as materialized (
    select row_number() over () as rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
           (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
    from documents),
ranked as (
    select source, sum(size)::bigint as source_size, count(*) as documents,
           [{", ".join(map(str, WEIGHTS))}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as weight
    from sized group by source),
filled as (
    select *, (sum({MOST_COPIES} * source_size) over w - {MOST_COPIES} * source_size)::double as capped_before,
           (sum(weight) over () - sum(weight) over w + weight)::double as weight_left,
           {SHARE}::double * (sum(source_size) over ())::double as total
    from ranked window w as (order by {MOST_COPIES} * source_size::double / weight, source nulls last rows unbounded preceding)),
levels as (select *, (total - capped_before) / weight_left as level, ({MOST_COPIES} * source_size)::double / weight as own from filled),
chosen as (select *, max(case when level <= own then level end) over () as final from levels),
targets as (
    select source, source_size, documents, case when own <= coalesce(final, own) then ({MOST_COPIES} * source_size)::double else final * weight end as target from chosen),
rates as (select *, case when source_size > 0 then target / source_size else 0.0 end as ratio from targets),
parts as (select *, floor(ratio)::bigint as whole, ratio - floor(ratio) as share, target - floor(ratio) * source_size as goal from rates),
lengths as (
    select d.*, {LEAN} * d.size // (d.size + greatest(1, s.source_size // s.documents)) as lean, s.source_size, s.target, s.whole, s.share, s.goal
    from sized d join parts s on d.source is not distinct from s.source),
leant as (
    select *, case when share > 0 then share + least(share, 1 - share) * ((sum(size * lean) over (partition by source))::double / ({LEAN} * source_size) - lean / {LEAN}) else 0 end as p from lengths),
odds as (
    select rid, doc_id, source, size, source_size, target, whole, p, goal, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as odds from leant),
runs as (
    select *, sum(size) over (partition by source order by odds / (1 + odds), doc_id, size rows unbounded preceding) as run,
           odds / (1 + odds) as place from odds),
marked as (
    select *, p > 0 and run <= goal as inside, goal - coalesce(max(case when run <= goal then run end) over (partition by source), 0) as room from runs),
fillers as (
    select rid from marked where p > 0 and not inside and room - abs(room - size) > 0
    qualify row_number() over (partition by source order by room - abs(room - size) desc, place, doc_id nulls first, size) = 1)
select doc_id, size, source_size, target,
       (size * (whole + case when inside or rid in (select rid from fillers) then 1 else 0 end))::bigint as taken
from marked
"""
