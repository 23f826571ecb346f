"""A small file of pairs with known results, empty inputs for every operator, and parameters handed on."""

from collections import Counter

import pytest

from rangeflow.operators import abundance, annotate, clusterfdr, clusters, extract, normalise, profiles, stats, tiles
from rangeflow.params import ExtractParams
from rangeflow.plans.containers import CountSet
from rangeflow.sources import sam

#: Records (name, flag, axis, place, operations, mate's axis, mate's place) and their results.
PAIRS = """
    good.1 97 chrA 10 10M = 90; good.1 145 chrA 90 10M = 10; good.2 97 chrA 20 10M = 80; good.2 145 chrA 80 10M = 20
    good.3 97 chrA 120 10M = 130; good.3 145 chrA 130 10M = 120; good.4 161 chrA 10 10M = 150; good.4 81 chrA 150 10M = 10
    same.1 112 chrA 80 10M = 150; same.1 176 chrA 150 10M = 80; diff.1 129 chrA 110 10M chrB 10; diff.1 65 chrB 10 10M chrA 110
    good.5 97 chrB 50 10M = 70; good.5 145 chrB 70 10M = 50; single.1 16 chrB 90 10M * 0; opposite.1 81 chrB 55 10M = 75
    opposite.1 161 chrB 75 10M = 55; good.6 97 chrB 3 10M = 3; good.6 145 chrB 3 10M = 3; close.1 81 chrB 80 20M = 90
    close.1 161 chrB 90 10M = 80; good.7 97 chrB 99 2M8S = 99; good.7 145 chrB 99 2M8S = 99
"""
SIZES = [70, 90, 20, 150, 10, 30, 10, 2]
DIAGNOSTICS = {"total": 23, "mapped": 23, "single": 3, "mate.unmapped": 0, "unoriented": 1, "inter.chr": 1}
WINDOWS = [("chrA", 1, 100), ("chrA", 51, 150), ("chrA", 101, 200), ("chrA", 151, 200), ("chrB", 1, 100), ("chrB", 51, 100)]
COUNTS = {"both": ([3, 4, 2, 1, 4, 3], 8), "first": ([3, 4, 4, 2, 6, 6], 10)}
SHORT_PAIRS = ([2, 3, 1, None, 4, 3], 7)
FETCHED = {"both": [(50, 79, "*"), (90, 99, "*"), (99, 100, "*")], "second": [(75, 84, "+"), (90, 99, "+"), (70, 79, "-"), (99, 100, "-")]}


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    records = [r.split() for r in PAIRS.replace("\n", ";").split(";") if r.strip()]
    lines = ["@SQ\tSN:chrA\tLN:200", "@SQ\tSN:chrB\tLN:100"] + ["\t".join([q, f, c, p, "200", ops, mc, mp, "0", "*", "*"]) for q, f, c, p, ops, mc, mp in records]
    path = tmp_path_factory.mktemp("sam") / "pairs.sam"
    path.write_text("\n".join(lines) + "\n")
    return sam.read_sam(spark, str(path)), sam.axis_catalog(sam.read_sam_axes(spark, str(path)))


def test_sizes_and_diagnostics(pairs):
    reads, axes = pairs
    both = ExtractParams(pe="both")
    assert sorted(r["size"] for r in extract.pair_sizes(reads, both).collect()) == sorted(SIZES)
    assert {r["measure"]: r["n"] for r in extract.pair_diagnostics(reads, both).collect()} == DIAGNOSTICS


@pytest.mark.parametrize("pe,max_frag,want", [("both", 500, COUNTS["both"]), ("both", 100, SHORT_PAIRS), ("first", 500, COUNTS["first"])])
def test_window_counts(pairs, pe, max_frag, want):
    reads, axes = pairs
    data = tiles.window_counts(reads, axes, ExtractParams(pe=pe, max_frag=max_frag), width=100, least=1)
    found = {(r["chrom"], r["start"], r["end"]): r["n"] for r in data.counts.collect()}
    assert found == {w: n for w, n in zip(WINDOWS, want[0], strict=True) if n is not None}
    assert data.libraries.first()["total"] == want[1]


@pytest.mark.parametrize("pe", ["both", "second"])
def test_fetched_region(pairs, pe):
    reads, axes = pairs
    rows = extract.fetch_region(reads, axes, "chrB", 50, 100, ExtractParams(pe=pe), None).collect()
    assert Counter((r["start"], r["end"], r["strand"]) for r in rows) == Counter(FETCHED[pe])


@pytest.mark.parametrize("start,end", [(60, 50), (150, 160)])
def test_inverted_region_is_refused(pairs, start, end):
    with pytest.raises(ValueError, match="behind its end"):
        extract.fetch_region(*pairs, "chrB", start, end, ExtractParams())


def test_container_keeps_parameters_and_is_committed_last(spark, pairs, tmp_path):
    reads, axes = pairs
    discard = spark.createDataFrame([("chrA", 1, 30)], "chrom string, start int, end int")
    params = ExtractParams(pe="first", min_mapq=20, restrict=("chrA",), discard=discard)
    data = tiles.window_counts(reads, axes, params, width=100, least=1)
    data.write(str(tmp_path / "whole"))
    back = CountSet.read(spark, str(tmp_path / "whole"))
    assert (back.params.pe, back.params.min_mapq, back.params.restrict, back.spacing) == ("first", 20, ("chrA",), 50)
    assert back.params.discard.collect() == discard.collect()
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, data.counts.collect()))
    data.counts.write.parquet(str(tmp_path / "half" / "counts"))
    with pytest.raises(ValueError, match="no container"):
        CountSet.read(spark, str(tmp_path / "half"))


def test_reform():
    params = ExtractParams(min_mapq=10).reform(ded=True, max=200)
    assert (params.dedup, params.max_frag, params.min_mapq) == (True, 200, 10)
    assert params.reform(restrict=None).restrict is None
    for bad in ({"m": 1}, {"nothing": 1}):
        with pytest.raises(ValueError, match="parameters"):
            params.reform(**bad)


def test_other_library_sizes_are_refused(spark, pairs):
    reads, axes = pairs
    data = tiles.window_counts(reads, axes, ExtractParams(pe="both"), width=100, least=1)
    other = data.replace(libraries=data.libraries.selectExpr("library", "total + 1 as total", "ext", "rlen"))
    for filter_by in (abundance.filter_local, lambda a, b: abundance.filter_global(a, axes, b)):
        with pytest.raises(ValueError, match="library sizes"):
            filter_by(data, other)


def test_offsets_are_handed_on(spark):
    counts = spark.createDataFrame([(i, "c", 1, 50, lib, (i * 7 + k * 3) % 40 + 1) for i in range(60) for k, lib in enumerate("ab")], "region_id bigint, chrom string, start int, end int, library string, n bigint")
    libraries = spark.createDataFrame([("a", 1200, None, 50), ("b", 1300, None, 50)], "library string, total bigint, ext int, rlen int")
    data = normalise.normalize(CountSet(counts, libraries), "loess")
    wide, samples, offsets = normalise.model_tables(data)
    want = {(r["region_id"], r["library"]): r["offset"] for r in data.counts.collect()}
    for r in offsets.collect():
        assert (r["a"], r["b"]) == (want[r["region_id"], "a"], want[r["region_id"], "b"])
        assert abs(r["a"] + r["b"]) < 1e-9
    assert wide.count() == offsets.count() == 60 and samples.count() == 2


READS = "library string, qname string, flag int, chrom string, pos int, mapq int, aln_len int, mate_chrom string, mate_pos int"
TESTS = "range_id bigint, cluster_id bigint, PValue double, logFC double, logCPM double, w double"
RANGES = "range_id bigint, chrom string, start bigint, end bigint, metric double, up boolean"
REGIONS = "region_id bigint, chrom string, start int, end int, strand string"


def test_empty_inputs(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    reads, tests, ranges, regions = map(none, (READS, TESTS, RANGES, REGIONS))
    axes = spark.createDataFrame([("chrA", 500, 1)], "chrom string, length int, ord int")
    single, both = ExtractParams(), ExtractParams(pe="both")
    windows, counted = tiles.window_counts(reads, axes, single), tiles.region_counts(reads, axes, regions.drop("strand"))
    frames = {
        "reads": extract.single_reads(reads, single), "fragments": extract.fragments(reads, axes, single), "pairs": extract.valid_pairs(reads, both), "diagnostics": extract.pair_diagnostics(reads, both),
        "sizes": extract.pair_sizes(reads, both), "region": extract.fetch_region(reads, axes, "chrA", 1, 100, single), "windows": windows.counts, "regions": counted.counts,
        "bins": tiles.window_counts(reads, axes, single, width=100, bins=True).counts, "profile": profiles.site_profile(reads, axes, regions.drop("strand"), single, reach=10).filter("false"),
        "bimodality": profiles.bimodality(reads, axes, regions.drop("strand")), "merged": clusters.merge_windows(ranges, 100), "signed": clusters.merge_windows(ranges, 100, "up", max_width=50),
        "maxima": clusters.find_maxima(ranges, 50, "metric"), "simes": stats.simes(tests, weight="w"), "best": stats.best_test(tests), "empirical": stats.empirical_fdr(tests), "mixed": stats.mixed_clusters(tests),
        "annotated": annotate.annotate_regions(regions, none("internal bigint, symbol string, chrom string, start int, end int, strand string, exon int")), "loess": normalise.loess_offsets(counted),
        "tmm": normalise.tmm_factors(counted), "rle": normalise.rle_factors(counted), "quartile": normalise.upper_quartile_factors(counted),
    }
    assert {name: df.count() for name, df in frames.items()} == dict.fromkeys(frames, 0)
    assert clusterfdr.cluster_fdr(tests.select("cluster_id", "w"), 0.05).first()["fdr"] == 0.0
    assert [normalise.model_tables(counted)[k].count() for k in (0, 1)] == [0, 0]
