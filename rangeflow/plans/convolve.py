"""Exact sums of products of counts by their distance, from histograms of blocks.

Pairs within max_dist would be as many rows as places times max_dist. Here both sides are gathered in
blocks of an axis, whose size depends on max_dist alone, and each pair of blocks is one convolution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Least places of a block, and the block's size in distances: the wider, the fewer places of the right side are dealt twice.
LEAST_BLOCK, DISTANCES = 4096, 4
#: Blocks with at most so many pairs of places are multiplied pair by pair.
FEW_PAIRS = 50_000
#: Counts are cut into digits of so many bits where rounding could reach an integer.
DIGIT = 12
#: A worker hands on its sums when it has those of so many axes.
AXES_HELD = 1000


def products(x: np.ndarray, y: np.ndarray, max_dist: int) -> np.ndarray:
    """Sums of x[i] * y[i + d] for d from 0 to max_dist, exact: by Fourier transforms whose error is below a quarter."""
    size = 1 << (len(x) + len(y)).bit_length()
    error = 4 * np.finfo(float).eps * np.log2(size) * np.sqrt((x.astype(float) ** 2).sum() * (y.astype(float) ** 2).sum())
    if error >= 0.25:
        if max(x.max(), y.max()) >> DIGIT:
            high = lambda v: v >> DIGIT
            low = lambda v: v & ((1 << DIGIT) - 1)
            if x.max() >= y.max():
                return products(low(x), y, max_dist) + (products(high(x), y, max_dist) << DIGIT)
            return products(x, low(y), max_dist) + (products(x, high(y), max_dist) << DIGIT)
        half = len(x) // 2  # long blocks of small counts
        return products(x[:half], y[: half + max_dist], max_dist) + products(x[half:], y[half:], max_dist)
    found = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)[: max_dist + 1]
    return np.rint(found).astype(np.int64)


def _block(xp: np.ndarray, xn: np.ndarray, yp: np.ndarray, yn: np.ndarray, block: int, max_dist: int) -> np.ndarray:
    """Sums for a pair of blocks, given as different places and their counts."""
    if len(xp) * len(yp) <= FEW_PAIRS:
        delay, product = (yp[None, :] - xp[:, None]).ravel(), (xn[:, None] * yn[None, :]).ravel()
        near = (delay >= 0) & (delay <= max_dist)
        out = np.zeros(max_dist + 1, np.int64)
        np.add.at(out, delay[near], product[near])
        return out
    x, y = np.zeros(block, np.int64), np.zeros(block + max_dist, np.int64)
    x[xp], y[yp] = xn, yn
    return products(x, y, max_dist)


def products_by_delay(left: DataFrame, right: DataFrame, max_dist: int) -> DataFrame:
    """(chrom, delay, xy): sums of left's n times right's n over places of right that lie delay behind left's, for delays with pairs.

    left and right: (chrom, pos, n), each place once. A worker holds a row of sums for each of at most
    AXES_HELD axes; a block has at most as many rows as places.
    """
    ship(left.sparkSession)
    block = max(LEAST_BLOCK, 1 << (DISTANCES * max_dist - 1).bit_length())

    def gathered(df: DataFrame, at, name: str) -> DataFrame:
        rows = df.groupBy("chrom", "_block").agg(F.collect_list(F.struct(at.cast("int").alias("p"), F.col("n").cast("bigint").alias("n"))).alias("v"))
        return rows.select("chrom", "_block", F.col("v.p").alias(f"{name}p"), F.col("v.n").alias(f"{name}n"))

    own, within = F.floor(F.col("pos") / block), F.pmod(F.col("pos"), F.lit(block))
    twice = F.filter(F.array(own, F.when(within < max_dist, own - 1)), lambda b: b.isNotNull())
    xs = gathered(left.select("chrom", "pos", "n", own.alias("_block")), within, "x")
    ys = gathered(right.select("chrom", "pos", "n", F.explode(twice).alias("_block")), F.col("pos") - F.col("_block") * block, "y")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for chrom, *sides in batch[["chrom", "xp", "xn", "yp", "yn"]].itertuples(index=False):
                found = _block(*[np.asarray(s, np.int64) for s in sides], block, max_dist)
                sums[chrom] = sums[chrom] + found if chrom in sums else found
            if len(sums) >= AXES_HELD:
                yield pd.DataFrame({"chrom": list(sums), "xy": list(sums.values())})
                sums = {}
        yield pd.DataFrame({"chrom": list(sums), "xy": list(sums.values())})

    found = xs.join(ys, ["chrom", "_block"]).select("chrom", "xp", "xn", "yp", "yn").mapInPandas(summed, "chrom string, xy array<bigint>")
    return found.select("chrom", F.posexplode("xy").alias("delay", "xy")).filter("xy > 0").groupBy("chrom", "delay").agg(F.sum("xy").alias("xy"))
