"""Window counts over a stream of reads against those of the table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rangeflow.operators.tiles import window_counts
from rangeflow.params import ExtractParams
from rangeflow.streaming.counts import streaming_pair_counts, streaming_pairs, streaming_window_counts
from rangeflow.views import Views


def test_stream_counts_equal_the_tables(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    v.reads.repartition(3).write.parquet(f"{tmp_path}/reads")
    stream = spark.readStream.schema(v.reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/reads")
    counts = streaming_window_counts(stream, v.axes, width=120)
    run = counts.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    assert run.awaitTermination(100)
    columns = ("library", "chrom", "k", "n")
    want = window_counts(v.reads, v.axes, width=120, least=1).counts.select(*columns)
    assert Counter(spark.table("streamed").select(*columns).collect()) == Counter(want.collect())


@pytest.mark.parametrize("strict", [False, True])
def test_pairs_of_a_stream_equal_the_tables(spark, tmp_path, strict):
    """Mates arrive in different files and up to eight minutes apart; reads without mates, far in the future, move the watermark at the end."""
    v = Views(spark, "/root/testdata/sf0.001")
    params = ExtractParams(pe="both")
    if strict:
        axes = sorted(r["chrom"] for r in v.axes.collect())
        params = params.reform(max_frag=300, min_mapq=10, dedup=True, restrict=axes[:2], discard=v.discard)
    timed = v.pairs.withColumn("time", F.timestamp_seconds(1_700_000_000 + F.crc32(F.concat_ws("/", "qname", "flag")) % 480))
    some = v.pairs.filter("flag & 9 = 1 and flag & 1024 = 0 and mapq >= 10 and chrom = mate_chrom")
    if strict:
        some = some.filter(F.col("chrom").isin(axes[:2]))
    last = some.filter("flag & 64 > 0").limit(40).unionAll(some.filter("flag & 128 > 0").limit(40)).withColumns({"qname": F.concat_ws("-", F.lit("last"), "qname", "flag"), "time": F.timestamp_seconds(F.lit(1_700_900_000))})
    for i in range(4):
        part = timed.filter(F.crc32(F.concat_ws("+", "qname", "flag")) % 3 == i) if i < 3 else last
        part.coalesce(1).write.parquet(f"{tmp_path}/reads/{i}")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/reads")
    counts = streaming_pair_counts(stream, v.axes, params, width=120)
    name = f"pairs{params.max_frag}"
    run = counts.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    assert run.awaitTermination(200)
    got = spark.table(name).groupBy("library", "chrom", "k").agg(F.sum("n").alias("n"))
    want = window_counts(v.pairs, v.axes, params, width=120, least=1).counts.select("library", "chrom", "k", "n").collect()
    assert want and Counter(got.collect()) == Counter(want)


def test_pairs_need_their_mode(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="pe='both'"):
        streaming_pairs(v.pairs, v.axes, ExtractParams())
    with pytest.raises(ValueError, match="streaming_pair_counts"):
        streaming_window_counts(v.pairs, v.axes, ExtractParams(pe="both"))
