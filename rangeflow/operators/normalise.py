"""Scaling factors (TMM, RLE, upper quartile) and loess offsets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import warn
from ..plans.containers import CountSet
from ..plans.localfit import local_trend
from ..plans.quantiles import exact_quantile
from ..plans.tables import settle
from .abundance import average_rank, library_sizes, scaled_average

#: Fixed values of the trimmed mean: shares of log-ratios and of intensities cut at either end.
TRIM_RATIO, TRIM_SUM = 0.3, 0.05


def _long(data: CountSet, sizes: DataFrame | None) -> DataFrame:
    """(range, library, n, size) of ranges with a fragment."""
    key = F.struct(*data.keys)
    if sizes is None:
        sizes = data.libraries.select("library", F.col("total").cast("double").alias("size"))
    rows = settle(data.counts.select(key.alias("range"), "library", "n"))
    grid = rows.groupBy("range").agg(F.sum("n").alias("all")).filter("all > 0").select("range").crossJoin(F.broadcast(sizes))  # every range has a count in each library
    return settle(grid.join(rows, ["range", "library"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double")))


def _geometric(factors: DataFrame) -> DataFrame:
    """Factors divided by their geometric mean: a row for each library."""
    mean = F.exp(F.avg(F.log("f")).over(Window.partitionBy()))
    return factors.select("library", (F.col("f") / mean).alias("norm_factor"))


def upper_quartile_factors(data: CountSet, sizes: DataFrame | None = None, p: float = 0.75) -> DataFrame:
    return _geometric(exact_quantile(_long(data, sizes), F.col("n") / F.col("size"), p, ("library",), "f"))


def rle_factors(data: CountSet, sizes: DataFrame | None = None) -> DataFrame:
    """Median ratio to the geometric mean over libraries, by library size."""
    rows = _long(data, sizes)
    means = rows.groupBy("range").agg(F.min("n").alias("least"), F.exp(F.avg(F.log(F.greatest("n", F.lit(1.0))))).alias("gm")).filter("least > 0")
    medians = exact_quantile(rows.join(means, "range"), F.col("n") / F.col("gm"), 0.5, ("library", "size"), "m")
    return _geometric(medians.select("library", (F.col("m") / F.col("size")).alias("f")))


def tmm_factors(data: CountSet, sizes: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(library, norm_factor): trimmed means of log-ratios to a reference library.

    The reference is the library whose upper quartile is nearest to the mean one. Ranks are averaged
    over ties and taken by scans over distinct values, not by sorting a library in one task.
    """
    rows = _long(data, sizes)
    quartiles = exact_quantile(rows, F.col("n") / F.col("size"), 0.75, ("library", "size"))  # a row for each library
    ref = quartiles.withColumn("d", F.abs(F.col("q") - F.avg("q").over(Window.partitionBy()))).agg(F.min_by("library", F.struct("d", "library")).alias("ref")).first()["ref"]
    base = rows.filter(F.col("library") == ref).select("range", F.col("n").alias("rn"), F.col("size").alias("rs"))
    both = rows.join(base, "range").filter("n > 0 and rn > 0")
    a, b = F.log2(F.col("n") / F.col("size")), F.log2(F.col("rn") / F.col("rs"))
    both = both.withColumns({"m": a - b, "a": (a + b) / 2, "v": (F.col("size") - F.col("n")) / F.col("size") / F.col("n") + (F.col("rs") - F.col("rn")) / F.col("rs") / F.col("rn")})
    # values equal but for rounding are ties
    both = settle(both.withColumns({"m": F.round("m", 12), "a": F.round("a", 12)}))
    ranked = average_rank(average_rank(both, "m", "rm", ("library",)), "a", "ra", ("library",))
    sums = both.groupBy("library").agg(F.count("*").alias("shared"), F.max(F.abs("m")).alias("most"))
    ranked = ranked.join(F.broadcast(sums), "library")  # a row for each library
    lo_m, lo_a = F.floor(F.col("shared") * TRIM_RATIO) + 1, F.floor(F.col("shared") * TRIM_SUM) + 1
    keep = F.col("rm").between(lo_m, F.col("shared") + 1 - lo_m) & F.col("ra").between(lo_a, F.col("shared") + 1 - lo_a)
    kept = ranked.filter(keep).groupBy("library").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v")) if weighted else F.avg("m")).alias("f"))
    out = quartiles.select("library").join(sums, "library", "left").join(kept, "library", "left")
    value = F.when(F.coalesce(F.col("most"), F.lit(0.0)) < 1e-6, 1.0).otherwise(F.pow(F.lit(2.0), F.coalesce("f", F.lit(0.0))))
    return _geometric(out.select("library", value.alias("f")))


METHODS = {"TMM": tmm_factors, "RLE": rle_factors, "upperquartile": upper_quartile_factors}


def loess_offsets(data: CountSet, span: float = 0.3) -> DataFrame:
    """(range keys, library, offset): trends of each library's log counts against the average, less the mean over libraries.

    Every count is a point of the local fit, and its trend is read at its own covariate.
    """
    names, sizes = library_sizes(data)
    if not names:
        return data.counts.select(*data.keys, "library", F.lit(0.0).alias("offset")).filter("false")
    mean = sum(sizes) / len(sizes)
    rows = settle(scaled_average(data.matrix(names), sizes, prior=0.5).withColumn("covariate", F.round(F.col("abundance") * float(np.log(2)), 9)).drop("abundance"))
    points = F.arrays_zip(F.array(*map(F.lit, names)).alias("library"), F.col("y").alias("n"), F.array(*[F.lit(s) for s in sizes]).alias("size"))
    long = rows.select(*data.keys, "covariate", F.explode(points).alias("p")).select(*data.keys, "covariate", "p.library", F.log(F.col("p.n") + 0.5 * F.col("p.size") / mean).alias("response"))
    out = local_trend(long, "covariate", "response", "library", rows, span, out="offset")
    return out.withColumn("offset", F.col("offset") - F.avg("offset").over(Window.partitionBy(*data.keys))).select(*data.keys, "library", "offset")


def norm_offsets(data: CountSet, kind: str = "scaling", method: str = "TMM", sizes: DataFrame | None = None, **kwargs) -> DataFrame:
    """Scaling factors of the libraries, or offsets of every count (kind="loess")."""
    if kind == "loess":
        return loess_offsets(data, **kwargs)
    if kind != "scaling":
        raise ValueError("kind must be scaling or loess")
    if sizes is None and "total" not in data.libraries.columns:
        warn("library sizes are not known: column sums are used")
        sizes = data.counts.groupBy("library").agg(F.sum("n").cast("double").alias("size"))
    return METHODS[method](data, sizes, **kwargs)


def normalize(data: CountSet, kind: str = "scaling", **kwargs) -> CountSet:
    """data with norm factors in its libraries, or with an offset column in its counts."""
    found = norm_offsets(data, kind, **kwargs)
    if kind == "scaling":
        return data.replace(libraries=data.libraries.drop("norm_factor").join(found, "library", "left"))
    return data.replace(counts=data.counts.join(found, [*data.keys, "library"], "left"))


def model_tables(data: CountSet, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(wide counts with a column for each library, samples(library, lib_size, norm_factor), wide offsets) for model packages.

    The offsets are None unless the counts have them, as normalize(kind="loess") leaves them.
    """
    names = [r[0] for r in data.libraries.select("library").orderBy("library").collect()]
    wide = data.counts.groupBy(*data.keys).pivot("library", names).agg(F.first("n")).fillna(0, names)
    factor = F.col("norm_factor") if "norm_factor" in data.libraries.columns else F.lit(1.0)
    samples = data.libraries.select("library", F.col("total").cast("double").alias("lib_size"), factor.alias("norm_factor"))
    if sizes is not None:
        samples = samples.drop("lib_size").join(sizes.withColumnRenamed("size", "lib_size"), "library")
    offsets = data.counts.groupBy(*data.keys).pivot("library", names).agg(F.first("offset")) if "offset" in data.counts.columns else None
    return wide, samples, offsets
