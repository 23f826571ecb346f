"""Local maxima against brute force, and the search for a threshold by running values against copies of rows."""

import random

import pytest
from pyspark.sql import functions as F

from rangeflow.operators import clusterfdr, clusters
from rangeflow.plans import scans


def some_windows(n, seed):
    """Short and long windows, some nested, equal or far from the others, on two axes and strands."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.choice([draw.randint(1, 3000), draw.randint(1, 3000), draw.randint(2_000_000, 2_003_000)])
        length = draw.choice([1, draw.randint(1, 40), draw.randint(1, 40), draw.randint(200, 2000)])
        rows.append((i, draw.choice(["a", "b"]), start, start + length - 1, draw.choice(["+", "-"]), float(draw.randint(0, 30)), draw.random() ** 2, draw.choice([0.5, 1.0, 3.0])))
    return rows + [(n + i, *r[1:]) for i, r in enumerate(rows[:10])]


SCHEMA = "range_id bigint, chrom string, start int, end int, strand string, m double, p double, w double"


@pytest.mark.parametrize("reach,stranded", [(1, False), (25, False), (25, True), (700, False)])
def test_maxima(spark, reach, stranded):
    rows = some_windows(250, reach)
    got = {r["range_id"]: r["is_max"] for r in clusters.find_maxima(spark.createDataFrame(rows, SCHEMA), reach, "m", ignore_strand=not stranded).collect()}
    near = lambda a, b: a[1] == b[1] and b[2] - a[3] <= reach and a[2] - b[3] <= reach and (not stranded or a[4] == b[4])
    assert got == {a[0]: a[5] >= max(b[5] for b in rows if near(a, b)) for a in rows}


def test_maxima_of_a_repeated_window(spark):
    """Many equal windows are one row of the search, however wide the reach."""
    rows = spark.range(20_000).selectExpr("id as range_id", "'a' as chrom", "cast(100 as int) as start", "cast(149 as int) as end", "cast(id % 7 as double) as m")
    assert clusters.find_maxima(rows, 100_000, "m").filter("is_max").count() == sum(i % 7 == 6 for i in range(20_000))


def test_maxima_without_windows_or_with_missing_metrics(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert clusters.find_maxima(empty, 5, "m").collect() == [] and "is_max" in clusters.find_maxima(empty, 5, "m").columns
    with pytest.raises(Exception, match="metric is missing"):
        clusters.find_maxima(spark.createDataFrame([(0, "a", 1, 9, "+", None, 0.1, 1.0)], SCHEMA), 5, "m").collect()


@pytest.mark.parametrize("signed,stranded,weight,block", [(False, False, None, 200_000), (True, False, "w", 200_000), (True, True, "w", 40)])
def test_sizes_at_all_points_are_those_of_each_point(spark, monkeypatch, signed, stranded, weight, block):
    monkeypatch.setattr(scans, "ONE_BLOCK", block)
    monkeypatch.setattr(clusters, "BLOCK_BASES", 700)
    rows = spark.createDataFrame(some_windows(150, 5), SCHEMA).withColumn("up", F.col("m") > 15)
    levels = [0.05, 0.2, 0.21, 0.7]
    first = F.size(F.filter(F.array(*map(F.lit, levels)), lambda x: x < F.col("p")))
    sign = "up" if signed else None
    marked = rows.withColumn("first", first).filter(F.col("first") < len(levels))
    got = sorted((r["grid"], r["chrom"], r["size"]) for r in clusters.sizes_at_levels(marked, "first", len(levels), 20, sign, weight, not stranded).collect())
    want = []
    for i, x in enumerate(levels):
        ids = clusters.merge_windows(rows.filter(F.col("p") <= x), 20, sign, ignore_strand=not stranded)
        want += [(i, r["chrom"], r["size"]) for r in ids.groupBy("cluster_id").agg(F.first("chrom").alias("chrom"), F.sum(weight or F.lit(1.0)).alias("size")).collect()]
    assert got == sorted(want)


def test_search_by_running_values_equals_the_search_by_copies(spark):
    rows = spark.createDataFrame(some_windows(200, 9), SCHEMA).withColumn("up", F.col("m") > 15)
    search = clusterfdr.Grid(points=9, rounds=3)

    def cluster(chosen, within):
        return clusters.merge_windows(chosen, 10, "up", within=within)

    def sizes(marked, first, points):
        return clusters.sizes_at_levels(marked, first, points, 10, "up")

    assert clusterfdr.control_cluster_fdr(0.2, rows, "p", cluster, search=search, sizes=sizes) == clusterfdr.control_cluster_fdr(0.2, rows, "p", cluster, search=search)
