"""Intermediate results written to the shared folder, so that plans stay small and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where the setting is unset, a folder of our own is used: a temporary one in local mode, else one in the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local[")
        folder = tempfile.mkdtemp(prefix="rangeflow-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_rangeflow"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/rangeflow-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; a settled frame is returned as it is."""
    if getattr(df, "_settled", False):
        return df
    spark, path = df.sparkSession, new_path(df.sparkSession, "scan")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = True
    return out
