"""BAM files written by Spark and read back, with and without their indexes."""

from collections import Counter

import pytest
from test_sources import AXES, alignments, expected

from rangeflow.sources import bam, bamwrite


@pytest.fixture
def written(spark, tmp_path):
    rows = alignments(4000, seed=9)
    axes = spark.createDataFrame([(n, size, i + 1) for i, (n, size) in enumerate(AXES)], "chrom string, length int, ord int")
    want = expected(rows, "lib")
    reads = spark.createDataFrame(list(want.elements()), bam.SCHEMA).repartition(5)
    path = str(tmp_path / "lib.bam")
    bamwrite.write_bam(reads, axes, path, parts=4)
    spark.dataSource.register(bam.BamDataSource)
    load = lambda **options: spark.read.format("bam").options(**options).load(path)
    return reads, axes, tmp_path / "lib.bam", want, load


def test_all_records_come_back(spark, written):
    _, _, path, want, load = written
    assert Counter(map(tuple, load().collect())) == want
    files = bam.files_of(str(path))
    assert len(files) == 4
    # each part holds a range of places of its own
    ranges = []
    for file in files:
        found = [(r["chrom"] is None, r["chrom"] or "", r["pos"]) for r in spark.read.format("bam").load(file).collect()]
        assert found == sorted(found)
        ranges.append((found[0], found[-1]))
    ranges.sort()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert bam.bam_axes([str(path)]) == [(str(path), n, size) for n, size in AXES]


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("region", ["chrA:100000-120000", "chrB:1-20", "chrC"])
def test_regions(written, index, region):
    _, _, path, want, load = written
    if not index:
        for file in path.glob("*.bai"):
            file.rename(file.with_suffix(".away"))
    name, start, end = bam.clamped(bam.read_region(region), AXES)
    inside = Counter({r: n for r, n in want.items() if r[3] == name and r[4] <= end and r[4] + max(r[6], 1) > start})
    assert Counter(map(tuple, load(region=region, partitionBytes=3000).collect())) == inside


def test_only_listed_parts_are_read(spark, written):
    reads, axes, path, want, load = written
    lost = path / "part-lost.bam"
    lost.write_bytes(b"half a block")
    assert load().count() == sum(want.values())
    with pytest.raises(ValueError, match="already written"):
        bamwrite.write_bam(reads, axes, str(path))
    (path / bam.MANIFEST).rename(path / "away")
    with pytest.raises(Exception, match="no written parts"):
        load().count()


def test_nulls_and_empty(spark, tmp_path):
    axes = spark.createDataFrame([("chrA", 500, 1)], "chrom string, length int, ord int")
    spark.dataSource.register(bam.BamDataSource)
    rows = [(None, None, None, None, None, None, None, None, None), ("x", "q", 0, "chrA", 500, 3, None, None, None)]
    bamwrite.write_bam(spark.createDataFrame(rows, bam.SCHEMA), axes, str(tmp_path / "nulls.bam"))
    got = sorted(map(tuple, spark.read.format("bam").load(str(tmp_path / "nulls.bam")).collect()))
    assert got == [("nulls", "*", 0, None, 0, 255, 0, None, 0), ("nulls", "q", 0, "chrA", 500, 3, 0, None, 0)]
    bamwrite.write_bam(spark.createDataFrame([], bam.SCHEMA), axes, str(tmp_path / "none.bam"))
    assert spark.read.format("bam").load(str(tmp_path / "none.bam")).count() == 0
    with pytest.raises(Exception, match="unknown axis"):
        bamwrite.write_bam(spark.createDataFrame([("x", "q", 0, "chrZ", 5, 3, 5, None, None)], bam.SCHEMA), axes, str(tmp_path / "bad.bam"))
    assert not (tmp_path / "bad.bam" / bam.MANIFEST).exists()
