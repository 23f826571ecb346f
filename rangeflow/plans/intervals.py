"""Interval joins without a native range join: both sides are dealt into bins of several sizes.

An interval belongs to the level whose bins are the smallest that are as long as itself, so that it
touches at most two of them. Two intervals meet at the level of the longer one, where the shorter one
touches at most two bins as well; only levels that the other side has are dealt. So the rows dealt
depend on the number of levels, not on the intervals' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settle

#: Sides of at most this many rows are broadcast instead of binned.
BROADCAST_ROWS = 5_000
#: Bins of a level are so many times as long as those of the level below.
STEP, LEVELS = 4, 20
#: Bins with more rows of a side are cut into parts where the sides have more than SALT_ROWS together.
HOT_ROWS, SALT_ROWS = 100_000, 1_000_000


def _level(start: Column, end: Column, size: int) -> Column:
    """The first level whose bins are as long as the interval."""
    length = end - start + 1
    return sum(((length > size * STEP**k).cast("int") for k in range(1, LEVELS)), (length > size).cast("int"))


def _levels(left: DataFrame, right: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Rows of each side at each level; one job."""
    rows = left.select(F.lit(0).alias("side"), "_level").unionAll(right.select(F.lit(1).alias("side"), F.col("_r_level").alias("_level"))).groupBy("side", "_level").count().collect()
    return tuple({r["_level"]: r["count"] for r in rows if r["side"] == side} for side in (0, 1))


def _dealt(df: DataFrame, name: str, start: Column, end: Column, tiers: list[tuple[int, Column, int]]) -> DataFrame:
    """A row for each bin of each tier (number, whether the row is in it, size of its bins) that the row touches."""
    bins = [F.when(among, F.struct(F.lit(number).alias("tier"), F.floor(start / size).alias("first"), F.floor(end / size).alias("last"))) for number, among, size in tiers]
    placed = df.withColumn(f"_{name}_in", F.explode(F.filter(F.array(*bins), lambda b: b.isNotNull())))
    placed = placed.withColumns({f"_{name}_tier": F.col(f"_{name}_in.tier"), f"_{name}_first": F.col(f"_{name}_in.first"), f"_{name}_last": F.col(f"_{name}_in.last")})
    return placed.withColumn(f"_{name}_bin", F.explode(F.sequence(f"_{name}_first", f"_{name}_last"))).drop(f"_{name}_in", f"_{name}_last")


def _salted(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with _l_part and _r_part: rows of hot bins are dealt into parts, and met with all parts of the other side."""
    a, b = settle(a), settle(b)
    keys = ("tier", "chrom", "bin")
    left = a.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, ("_l_tier", "chrom", "_l_bin"), strict=True)]).agg(F.count("*").alias("n"), F.lit(0).alias("m"))
    right = b.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, ("_r_tier", "r_chrom", "_r_bin"), strict=True)]).agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("m"))
    counts = left.unionByName(right.withColumn("m", F.col("m"))).groupBy(*keys).agg(F.ceil(F.sum("n") / HOT_ROWS).alias("l_parts"), F.ceil(F.sum("m") / HOT_ROWS).alias("r_parts"))
    hot = settle(counts.filter("(l_parts > 1 or r_parts > 1) and l_parts > 0 and r_parts > 0"))
    out = []
    for df, me, other, chrom in ((a, "l", "r", "chrom"), (b, "r", "l", "r_chrom")):
        on = (df[f"_{me}_tier"] == hot["tier"]) & (df[chrom] == hot["chrom"]) & (df[f"_{me}_bin"] == hot["bin"])
        parted = df.join(hot.select(*[F.col(k) for k in keys], F.col(f"{me}_parts").alias("_own"), F.col(f"{other}_parts").alias("_others")), on, "left").drop(*[hot[k] for k in keys])
        parted = parted.withColumn(f"_{me}_own", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_own", F.lit(1))))
        parted = parted.withColumn(f"_{me}_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_others", F.lit(1)) - 1))).drop("_own", "_others")
        out.append(parted)
    return out[0], out[1]


def _touching(gap: int, within: bool, min_overlap: int, stranded: bool) -> Column:
    touch = (F.col("start") <= F.col("r_end") + gap) & (F.col("end") >= F.col("r_start") - gap)
    if stranded:
        touch = touch & ((F.col("strand") == F.col("r_strand")) | (F.col("strand") == "*") | (F.col("r_strand") == "*"))
    if within:
        touch = touch & (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    if min_overlap > 1:
        touch = touch & (F.least("end", "r_end") - F.greatest("start", "r_start") + 1 >= min_overlap)
    return touch


def interval_join(left: DataFrame, right: DataFrame, bin_size: int = 1000, gap: int = 0, within: bool = False, min_overlap: int = 1, how: str = "inner", small: bool = False, stranded: bool = False) -> DataFrame:
    """Pairs of left(chrom, start, end, ...) and right(chrom, start, end, ...) that overlap.

    Right's columns come prefixed with r_. gap widens right by so many bases on both sides; within
    asks for left to lie inside right; min_overlap for so many common bases. A pair meets in every
    bin that both touch at its level and is kept in the first of them, so nothing is counted twice.
    bin_size is that of the lowest level. small says that right is known to be small and may be
    broadcast as it is. how: inner, left_semi, left_anti.
    """
    right = right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
    touch = _touching(gap, within, min_overlap, stranded)
    if small:
        return left.join(F.broadcast(right), (F.col("chrom") == F.col("r_chrom")) & touch, how)
    r_start, r_end = F.col("r_start") - gap, F.col("r_end") + gap
    right = right.withColumn("_r_level", _level(r_start, r_end, bin_size))
    if how != "inner":
        if not within:
            raise ValueError("semi and anti joins of large sides need within=True")
        return _inside(left, right, touch, bin_size, r_start, r_end, how)
    columns = [*left.columns, *[c for c in right.columns if c != "_r_level"]]
    left = left.withColumn("_level", _level(F.col("start"), F.col("end"), bin_size))
    own, others = _levels(left, right)
    if not own or not others:
        return left.join(right, F.lit(False)).select(*columns)
    # tiers: the longer interval is right's (its level's number), or left's (a number beyond those)
    sizes = {k: bin_size * STEP**k for k in own | others}
    longer = [k for k in sorted(own) if k > min(others)]
    a = _dealt(left, "l", F.col("start"), F.col("end"), [(k, F.col("_level") <= k, sizes[k]) for k in sorted(others) if k >= min(own)] + [(LEVELS + 1 + k, F.col("_level") == k, sizes[k]) for k in longer])
    b = _dealt(right, "r", r_start, r_end, [(k, F.col("_r_level") == k, sizes[k]) for k in sorted(others) if k >= min(own)] + [(LEVELS + 1 + k, F.col("_r_level") < k, sizes[k]) for k in longer])
    on = (F.col("_l_tier") == F.col("_r_tier")) & (F.col("chrom") == F.col("r_chrom")) & (F.col("_l_bin") == F.col("_r_bin"))
    if sum(own.values()) + sum(others.values()) > SALT_ROWS:
        a, b = _salted(a, b)
        on = on & (F.col("_l_own") == F.col("_r_other")) & (F.col("_l_other") == F.col("_r_own"))
    return a.join(b, on & touch & (F.col("_l_bin") == F.greatest("_l_first", "_r_first"))).select(*columns)


def _inside(left: DataFrame, right: DataFrame, touch: Column, bin_size: int, r_start: Column, r_end: Column, how: str) -> DataFrame:
    """Rows of left that lie in a range of right, or those that don't: one level of right after the other.

    An interval inside a range shares the bin of its start with it.
    """
    right, rest, found = settle(right), left, left.filter("false")
    for (level,) in right.select("_r_level").distinct().orderBy("_r_level").collect():
        size = bin_size * STEP**level
        binned = _dealt(right.filter(F.col("_r_level") == level), "r", r_start, r_end, [(level, F.lit(True), size)])
        on = (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("start") / size) == F.col("_r_bin")) & touch
        if how == "left_semi":
            found = found.unionByName(rest.join(binned, on, "left_semi"))
        rest = rest.join(binned, on, "left_anti")
    return rest if how == "left_anti" else found


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows
