"""Robust local linear trends of distributed points, from moments.

The trend is fitted at knots, quantiles of x. A knot's neighbours are all values within its distance h,
that to its span-th nearest value; they weigh (1 - (|x - knot| / h)**3)**3. Between the ends of these
reaches every weight is a polynomial of x, so sums of powers of x in each stretch give the same
weighted sums as the points themselves: a round reads the points once, whatever the span, and its
groups have one row for each stretch.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .quantiles import exact_quantile
from .scans import block_scan, value_blocks
from .tables import settle

#: The trend is fitted at so many quantiles of x, and is linear between them.
KNOTS = 200
#: Powers of x whose sums a local linear fit takes: the weight has degree 9, and the fit two more.
POWERS = 12
#: A fit whose points spread less than this share of the range of x is their mean.
LEAST_SPREAD = 0.001
#: The least reach of a knot, below the steps of x.
LEAST_REACH = 1e-10


def place_among(cuts: list[float], x: Column) -> Column:
    """How many of the sorted cuts are at most x, found by halving."""
    if not cuts:
        return F.lit(0)
    known, steps = F.lit(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    further = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(known, at + step - 1) <= x), at + step).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), further)


def nearest_reaches(df: DataFrame, x: str, span: float, knots: int = KNOTS) -> list[tuple[float, float]]:
    """[(knot, reach)] in order of the knots: quantiles of x, and the distances to their ceil(span * n)-th nearest values.

    Runs of near values of x lie between their outermost two. Each different value is the low end of
    one run or more and the high end of others; of these, the one with the nearest other end counts.
    A few rows for each knot come to the driver.
    """
    steps = settle(df.groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("c")).filter("v is not null"))
    steps = settle(block_scan(value_blocks(steps, "v"), [], "block", ["v"], {"e": ("sum", F.col("c"))}).select("v", "c", "e"))
    n = steps.agg(F.max("e").alias("n")).first()["n"]
    if not n:
        return []
    near, many = min(n, max(2, math.ceil(span * n))), min(n, knots)
    at = [i * (n - 1) / max(1, many - 1) for i in range(many)]
    wanted = sorted({float(r) for a in at for r in (math.floor(a), math.ceil(a))})
    hit = place_among(wanted, (F.col("e") - 1).cast("double")) > place_among(wanted, (F.col("e") - F.col("c") - 1).cast("double"))
    values = sorted((r["e"], r["v"]) for r in steps.filter(hit).collect())
    value = lambda r: values[bisect.bisect_right(values, (r, math.inf))][1]
    places = sorted({value(math.floor(a)) + (value(math.ceil(a)) - value(math.floor(a))) * (a - math.floor(a)) for a in at})
    other = lambda rank, low: steps.select(rank.alias("rank"), F.lit(0).alias("is_step"), F.lit(None).cast("double").alias("v"), F.col("v").alias("end"), F.lit(low).alias("low"))
    ends = steps.select((F.col("e") - 1).alias("rank"), F.lit(1).alias("is_step"), "v", F.lit(None).cast("double").alias("end"), F.lit(None).cast("boolean").alias("low"))
    rows = ends.unionByName(other(F.col("e") - F.col("c") + near - 1, True)).unionByName(other(F.col("e") - near, False)).filter(F.col("rank").between(0, n - 1))
    found = block_scan(value_blocks(rows, "rank"), [], "block", ["rank", "is_step"], {"at": ("min", F.col("v"))}, reverse=True).filter("is_step = 0")
    lo, hi = F.when(F.col("low"), F.col("end")).otherwise(F.col("at")), F.when(F.col("low"), F.col("at")).otherwise(F.col("end"))
    found = found.groupBy(place_among(places, (lo + hi) / 2).alias("place")).agg(F.max(lo).alias("lo"), F.min(hi).alias("hi")).collect()
    reach = lambda k, p: min([p - r["lo"] for r in found if r["place"] <= k] + [r["hi"] - p for r in found if r["place"] > k])
    return [(p, max(reach(k, p), LEAST_REACH)) for k, p in enumerate(places)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials: a row of coefficients each, from the constant on."""
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for i in range(a.shape[1]):
        out[:, i : i + b.shape[1]] += a[:, i : i + 1] * b
    return out


@dataclass
class Stretches:
    """The stretches of x between the ends of the knots' reaches: where they begin, their middles and half widths."""

    knots: list[float]
    reaches: list[float]

    def __post_init__(self):
        first, last = self.knots[0], self.knots[-1]
        self.limits = [(max(first, p - h), min(last, p + h)) for p, h in zip(self.knots, self.reaches, strict=True)]
        self.cuts = sorted({*self.knots, *(c for pair in self.limits for c in pair)})
        inner = list(zip(self.cuts, self.cuts[1:], strict=False))
        self.middles = [first, *((a + b) / 2 for a, b in inner), last]
        self.halves = [1.0, *((b - a) / 2 for a, b in inner), 1.0]

    def place(self, x: Column) -> tuple[Column, Column]:
        """(stretch, place within it from -1 to 1) of x."""
        stretch = place_among(self.cuts, x)
        return stretch, (x - F.get(F.lit(self.middles), stretch)) / F.get(F.lit(self.halves), stretch)

    def fit(self, sums: np.ndarray) -> np.ndarray:
        """The trend at the knots from sums[stretch]: of the weights times powers of the place, then of those times y."""
        spread, values = self.knots[-1] - self.knots[0], np.full(len(self.knots), np.nan)
        middles, halves = np.array(self.middles), np.array(self.halves)
        for k, (p, h) in enumerate(zip(self.knots, self.reaches, strict=True)):
            lo, hi = (bisect.bisect_left(self.cuts, c) for c in self.limits[k])
            inside = slice(lo + 1, hi + 1 + (hi == len(self.cuts) - 1))
            u = np.stack([middles[inside] - p, halves[inside]], axis=1) / h
            away = u * np.where(middles[inside] >= p, 1, -1)[:, None]
            short = -_times(away, _times(away, away))
            short[:, 0] += 1
            kernel = _times(short, _times(short, short))
            xs, ys = sums[inside, :POWERS], sums[inside, POWERS:]
            by_u = _times(kernel, u)
            totals = np.array([(c * of[:, : c.shape[1]]).sum() for c, of in [(kernel, xs), (by_u, xs), (_times(by_u, u), xs), (kernel, ys), (by_u, ys)]])
            weight = xs[:, 0].sum()
            if totals[0] > 1e-12 * weight:
                _, mx, mxx, my, mxy = totals / totals[0]
                variance = mxx - mx * mx
                steep = variance > 0 and math.sqrt(variance) * h > LEAST_SPREAD * spread
                values[k] = my - (mxy - mx * my) / variance * mx if steep else my
        known = np.isfinite(values)
        return np.interp(self.knots, np.array(self.knots)[known], values[known]) if known.any() else np.zeros(len(values))

    def lines(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch, the trend in its middle and its rise from there to the stretch's end."""
        middle = np.interp(self.middles, self.knots, values)
        ends = np.interp(np.array(self.middles) + np.array(self.halves), self.knots, values)
        rise = ends - middle
        rise[[0, -1]] = 0.0
        return middle, rise


def local_trend(points: DataFrame, x: str, y: str, by: str, places: DataFrame, span: float = 0.3, rounds: int = 4, knots: int = KNOTS, out: str = "trend") -> DataFrame:
    """points and column out: the robust local linear trend of y along x in each group of column by.

    places has each value of x once for each of its points in a group; the groups share these values.
    After each round but the last, points weigh (1 - (r / (6 * median r))**2)**2 by their distance r
    from the trend, 0 beyond. A knot all of whose points weigh 0 takes its value from the knots beside it.
    """
    ship(points.sparkSession)
    found = nearest_reaches(places, x, span, knots)
    if not found:
        return points.withColumn(out, F.lit(None).cast("double"))
    stretches = Stretches(*map(list, zip(*found, strict=True)))
    stretch, place = stretches.place(F.col(x).cast("double"))
    points = settle(points.withColumns({"_s": stretch, "_t": place}))
    power = [F.lit(1.0)]
    for _ in range(POWERS - 1):
        power.append(power[-1] * F.col("_t"))
    names = [f"_m{i}" for i in range(2 * POWERS - 1)]

    def fitted(sums: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((len(stretches.middles), len(names)))
        table[sums["_s"].to_numpy()] = sums[names].to_numpy()
        middle, rise = stretches.lines(stretches.fit(table))
        return pd.DataFrame({by: sums[by].iloc[:1], "_middle": [middle], "_rise": [rise]})

    def fit(rows: DataFrame) -> DataFrame:
        """A row for each group: its trend in each stretch."""
        sums = [F.sum(F.col("_w") * p) for p in power] + [F.sum(F.col("_w") * F.col(y) * p) for p in power[:-1]]
        table = rows.groupBy(by, "_s").agg(*[c.alias(n) for c, n in zip(sums, names, strict=True)])
        kind = dict(rows.dtypes)[by]
        return settle(table.groupBy(by).applyInPandas(fitted, f"`{by}` {kind}, _middle array<double>, _rise array<double>"))

    value = F.get("_middle", F.col("_s")) + F.get("_rise", F.col("_s")) * F.col("_t")
    with_trend = lambda rows, trends: rows.join(F.broadcast(trends), by).withColumn(out, value).drop("_middle", "_rise")
    rows = points.withColumn("_w", F.lit(1.0))
    for _ in range(rounds - 1):
        rows = settle(with_trend(rows, fit(rows)).withColumn("_r", F.abs(F.col(y) - F.col(out))).drop(out))
        scale = settle(exact_quantile(rows, "_r", 0.5, (by,), "_scale"))
        near = F.pow(F.greatest(F.lit(0.0), 1 - F.pow(F.col("_r") / (6 * F.greatest("_scale", F.lit(1e-300))), F.lit(2.0))), F.lit(2.0))
        weight = F.when(6 * F.col("_scale") < 1e-12, F.col("_w")).otherwise(near)
        rows = rows.join(F.broadcast(scale), by).withColumn("_w", weight).drop("_r", "_scale")
    return with_trend(points, fit(rows)).drop("_s", "_t")
