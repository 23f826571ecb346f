"""Ordered scans in two phases, and false-discovery adjustments on them.

A plain window over an axis runs in one task. Here the rows are cut into blocks by an explicit block
column; each block is scanned on its own, block totals are scanned (a row for each block), and the
carried value is added. The input is written once, as both phases read it; up to ONE_BLOCK rows a
plain window does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settle

#: Rows up to this number are scanned as one block.
ONE_BLOCK = 200_000
BLOCKS = 256

_FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carried)
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def block_scan(df: DataFrame, parts: list[str], block: str, order: list[str], values: dict[str, tuple[str, Column]], exclusive: bool = False, reverse: bool = False) -> DataFrame:
    """Adds running values along parts, ordered by block and then by order.

    values: name -> (sum, max, min or last, expression). exclusive leaves the row itself out;
    reverse runs from the end. Blocks must be ranges of the order.
    """
    df = settle(df)
    if df.count() <= ONE_BLOCK:
        frame = (Window.unboundedPreceding, -1 if exclusive else 0)
        whole = [F.desc(o) if reverse else F.col(o) for o in [block, *order]]
        along = Window.partitionBy(*parts).orderBy(*whole).rowsBetween(*frame)
        return df.withColumns({n: F.coalesce(_FUNCTIONS[k](e).over(along), F.lit(0)) if k == "sum" else _FUNCTIONS[k](e).over(along) for n, (k, e) in values.items()})
    ordering = [F.desc(o) if reverse else F.col(o) for o in order]
    inner = Window.partitionBy(*parts, block).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = df.groupBy(*parts, block)
    if any(k == "last" for k, _ in values.values()):
        # the last value of a block in its order: the greatest place that has one
        place = F.struct(*order)
        totals = totals.agg(*[(F.max_by(e, F.when(e.isNotNull(), place)) if k == "last" else _FUNCTIONS[k](e)).alias(f"_t_{n}") for n, (k, e) in values.items()])
    else:
        totals = totals.agg(*[_FUNCTIONS[k](e).alias(f"_t_{n}") for n, (k, e) in values.items()])
    outer = Window.partitionBy(*parts) if parts else Window.partitionBy()
    outer = outer.orderBy(F.desc(block) if reverse else F.col(block)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_b_{c}") for c in [*parts, block]], *[_FUNCTIONS[k](f"_t_{n}").over(outer).alias(f"_c_{n}") for n, (k, _) in values.items()])
    local = df.withColumns({f"_l_{n}": _FUNCTIONS[k](e).over(inner) for n, (k, e) in values.items()})
    on = [local[c].eqNullSafe(totals[f"_b_{c}"]) for c in [*parts, block]]
    both = local.join(totals, on)
    return both.select(*df.columns, *[_combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in values.items()])


def value_blocks(df: DataFrame, value: str, blocks: int = BLOCKS) -> DataFrame:
    """Adds block: ranges of value with about equal rows; one block where there are few rows."""
    df = settle(df)
    stats = df.agg(F.count("*").alias("n"), F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 10_000).alias("cuts")).first()
    if stats["n"] <= ONE_BLOCK:
        out = df.withColumn("block", F.lit(0))
        out._settled = True  # a constant beside the written rows
        return out
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(stats["cuts"]))])
    return df.withColumn("block", F.size(F.filter(cuts, lambda c: c < F.col(value))))


def adjusted(df: DataFrame, p: str, out: str, weight: str | None = None) -> DataFrame:
    """Adds Benjamini-Hochberg adjusted values of column p as out; null where p is null.

    With weight, each test counts as much as its weight. Tied p-values are one step of the scan, so
    many rows with one value cost nothing.
    """
    df = settle(df)
    w = F.col(weight) if weight else F.lit(1)
    steps = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.sum(w).alias("_w"))
    steps = value_blocks(steps, "_p")
    steps = block_scan(steps, [], "block", ["_p"], {"_cum": ("sum", F.col("_w"))})
    steps = settle(steps)
    total = steps.agg(F.max("_cum").alias("_all")).first()["_all"]
    steps = steps.withColumn("_raw", F.col("_p") * F.lit(total) / F.col("_cum"))
    steps = block_scan(steps, [], "block", ["_p"], {"_adj": ("min", F.col("_raw"))}, reverse=True)
    steps = steps.select("_p", F.least(F.lit(1.0), "_adj").alias(out))
    return df.join(steps, df[p] == steps["_p"], "left").drop("_p")
