"""Whitening of embedding vectors by MLlib's distributed singular value decomposition.

The fit list holds each distinct integer vector once. Its rows, centred by their exact sums, are a
RowMatrix whose singular values s give the covariance's eigenvalues s * s / n, with the right singular
vectors as components. The total variance comes from the exact integer deviations instead, so that
what a component explains doesn't depend on the decomposition.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; rows
with a null id keep it; repeated rows count once in the fit and get their values each; components
without variance are not returned, so that equal vectors, one vector or empty ones give no rows;
vectors of different lengths are a ValueError; deviations that no 64-bit integer holds are an
arithmetic error; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored
from .negatives import finite, integers

COMPONENTS = 4
#: Eigenvalues below this share of the largest are rounding, not variance.
LEAST_SHARE = 1e-12

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _array(values, kind: str):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for integer vectors."""
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("x")), "whitening-rows")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, shortest, longest = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != longest:
        raise ValueError(f"{vector_col} has vectors of {shortest} to {longest} components")
    if not longest:
        return spark.createDataFrame([], RESULT)
    # one number for each dimension
    sums = [r["s"] for r in fit.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("s")).orderBy("k").collect()]
    deviation = F.aggregate(F.zip_with("x", _array(sums, "bigint"), lambda c, s: F.lit(n).cast("bigint") * c - s), F.lit(0).cast("bigint"), lambda a, d: a + d * d)
    centred = F.transform(F.zip_with("x", _array(sums, "bigint"), lambda c, s: F.lit(n).cast("bigint") * c - s), lambda d: d.cast("double") / n)

    total = float(fit.agg(F.sum(deviation.cast("decimal(38,0)"))).first()[0]) / float(n) ** 3
    matrix = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v")
    # all values are asked for: MLlib then decomposes the Gramian matrix directly instead of iterating to a tolerance
    found = RowMatrix(matrix, n, longest).computeSVD(longest) if total else None
    values = np.array(found.s.toArray())[:components] ** 2 / n if found else np.zeros(0)
    values = values[values > LEAST_SHARE * values.max(initial=0)]
    if not len(values):
        return spark.createDataFrame([], RESULT)
    axes = found.V.toArray()[:, : len(values)] / np.sqrt(values)

    def projected(k: int):
        return F.aggregate(F.zip_with(centred, _array(axes[:, k].tolist(), "double"), lambda c, a: c * a), F.lit(0.0), lambda s, p: s + p)

    names = [f"w{k}" for k in range(len(values))]
    moments = [F.sum(F.col(a)).alias(f"s_{a}") for a in names] + [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    moments = fit.select(*[projected(k).alias(a) for k, a in enumerate(names)]).agg(*moments).first()
    error = max(abs(moments[f"s_{a}_{b}"] / n - moments[f"s_{a}"] / n * moments[f"s_{b}"] / n - (a == b)) for i, a in enumerate(names) for b in names[: i + 1])

    per_component = F.array(*[F.struct(F.lit(k + 1).alias("component"), projected(k).alias("whitened"), F.lit(float(v) / total).alias("explained")) for k, v in enumerate(values)])
    out = rows.select("vec_id", deviation.alias("deviation"), F.explode(per_component).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(finite(F.col("embedding")))
    return whiten(table.select("vec_id", integers(F.col("embedding")).alias("x")), "vec_id", "x")
