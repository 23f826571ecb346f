"""Exact quantiles by repeated narrowing: no task sees more than a block of different values of a group.

Each round draws cuts from a sketch of bounded size, counts the values between cuts and keeps only
those in the ranges that hold the wanted ranks. The sketch only decides how far a round narrows: the
counts are exact, and so is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settle

#: Inputs of at most this many rows are aggregated at once; larger ones are narrowed to so many different values of a group.
ONE_BLOCK = 200_000
CUTS, ACCURACY = 256, 10_000


def exact_quantile(df: DataFrame, value: Column | str, p: float, by: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    """(by..., out): the value at p of each group, linear between the two nearest ranks; nulls don't count.

    Groups without values have no row; without by there is one row, null where there are no values.
    """
    column = value if isinstance(value, Column) else F.col(value)
    keys = list(by)
    rows = df.select(*keys, column.cast("double").alias("_v")).filter("_v is not null")
    if getattr(df, "_settled", False):
        rows._settled = True  # columns of written rows
    else:
        rows = settle(rows)
    if rows.count() <= ONE_BLOCK:
        return rows.groupBy(*keys).agg(F.percentile("_v", p).alias(out))
    if not keys:
        return exact_quantile(rows.withColumn("_all", F.lit(0)), "_v", p, ("_all",), out).select(out)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = (F.col("_n") - 1) * F.lit(float(p))
    # a row for each group: its two ranks, less the values below those that are left
    want = settle(sizes.select(*keys, at.alias("_at"), F.lit(0).cast("bigint").alias("_below")))
    rows = rows.withColumn("_c", F.lit(1).cast("bigint"))
    while True:
        if not rows.groupBy(*keys).count().filter(F.col("count") > ONE_BLOCK).limit(1).count():
            break
        cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], ACCURACY).alias("_cuts"))
        placed = rows.join(settle(cuts), keys).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        counts = placed.groupBy(*keys, "_block").agg(F.sum("_c").alias("_n")).join(want, keys)
        # at most CUTS rows of each group
        counts = counts.withColumn("_upto", F.expr(f"_below + sum(_n) over (partition by {', '.join(f'`{k}`' for k in keys)} order by _block)"))
        kept = counts.filter((F.col("_upto") > F.floor("_at")) & (F.col("_upto") - F.col("_n") <= F.ceil("_at")))
        kept = settle(kept.groupBy(*keys, "_at").agg(F.min("_block").alias("_first"), F.max("_block").alias("_last"), F.min(F.col("_upto") - F.col("_n")).alias("_below")))
        inside = placed.join(kept.select(*keys, "_first", "_last"), keys).filter("_block between _first and _last")
        rows = settle(inside.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")))
        want = settle(kept.select(*keys, "_at", "_below"))
    ordered = rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")).join(want, keys)
    ordered = ordered.withColumn("_upto", F.expr(f"_below + sum(_c) over (partition by {', '.join(f'`{k}`' for k in keys)} order by _v)"))
    low = F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("_v")))
    high = F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_v")))
    found = ordered.groupBy(*keys, "_at").agg(low.alias("_low"), high.alias("_high"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    return found.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias(out))
