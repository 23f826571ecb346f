"""Coverage around each site against plain counting, and what a run of it shuffles."""

import math

import pytest

from rangeflow.operators import profiles
from rangeflow.params import ExtractParams
from rangeflow.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
LENGTHS = {"chrA": 6000, "chrB": 2500, "chrC": 1500}
#: Reads (axis, first base, bases, reverse): at the ends of axes, at the borders of tiles of 1000 bases, twice at a place; chrC has none.
READS = [("chrA", 1, 30, False), ("chrA", 5985, 30, True), ("chrA", 1000, 20, False), ("chrA", 901, 100, False), ("chrA", 2999, 40, True), ("chrA", 3040, 25, True), ("chrA", 3040, 25, True), ("chrA", 3100, 50, False), ("chrB", 2450, 50, True), ("chrB", 10, 20, False)]
#: Regions (id, axis, start, end, strand): one twice, one on an axis without reads, one on an unknown axis, some that reach beyond their axis.
REGIONS = [(1, "chrA", 3000, 3120, "-"), (2, "chrA", 3050, 3060, "+"), (3, "chrA", 5, 90, "*"), (4, "chrA", 5990, 6000, "-"), (5, "chrB", 30, 2470, "-"), (6, "chrC", 700, 900, "+"), (7, "chrX", 10, 20, "+"), (2, "chrA", 3050, 3060, "+"), (8, "chrA", 999, 1001, "*")]


def frames(spark):
    reads = spark.createDataFrame([("a", f"q{i}", 16 * rev, c, pos, 60, n, None, None) for i, (c, pos, n, rev) in enumerate(READS)], "library string, qname string, flag int, chrom string, pos int, mapq int, aln_len int, mate_chrom string, mate_pos int")
    axes = spark.createDataFrame(list(LENGTHS.items()), "chrom string, length int")
    return reads, axes, spark.createDataFrame(REGIONS, "region_id bigint, chrom string, start int, end int, strand string")


def counted(reach: int, ext: int, normalize: str, strand: str) -> dict:
    """(region, offset): value, base by base."""
    out = {}
    for region, chrom, start, end, sign in set(REGIONS):
        times, flip = REGIONS.count((region, chrom, start, end, sign)), strand != "ignore" and sign == "-"
        anchor, values = end if flip else start, {}
        for offset in range(-reach, reach + 1):
            base, n = anchor - offset if flip else anchor + offset, 0
            for c, pos, bases, rev in READS:
                lo, hi = (pos + bases - ext, pos + bases - 1) if rev else (pos, pos + ext - 1)
                lo, hi = (max(1, min(LENGTHS[c], x)) for x in (lo, hi))
                n += c == chrom and lo <= base <= hi and (strand != "match" or rev == flip)
            values[offset] = float(n * times)
        by = {"none": 1.0, "total": sum(values.values()), "max": max(values.values())}[normalize]
        out |= {(region, o): v / by if by else math.nan for o, v in values.items()}
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
@pytest.mark.parametrize("ext,normalize,strand", [(100, "none", "match"), (2600, "none", "match"), (100, "none", "ignore"), (1000, "total", "use"), (100, "max", "match")])
def test_values_of_each_site(spark, monkeypatch, ext, normalize, strand, hot):
    monkeypatch.setattr(profiles, "HOT_SITES", hot, raising=False)
    reads, axes, regions = frames(spark)
    rows = profiles.site_profile(reads, axes, regions, ExtractParams(forward="split"), reach=120, ext=ext, average=False, normalize=normalize, strand=strand).collect()
    want = counted(120, ext, normalize, strand)
    got = {(r["region_id"], r["offset"]): r["value"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True) for k in want)


def shuffled_rows(spark) -> int:
    """Rows that all stages of the session so far wrote to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_value_for_each_offset_is_not_dealt(spark):
    """200 sites have 601 offsets each; reads and sites come to a tenth of that."""
    before = shuffled_rows(spark)
    out = QUERIES["site_profile_stranded"](spark, SF_DIR)
    out.write.format("noop").mode("overwrite").save()
    assert shuffled_rows(spark) - before < 200 * 601 / 10
