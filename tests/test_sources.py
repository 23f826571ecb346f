"""Alignment files and gene models, written by the tests and read back."""

import random
import struct
import zlib
from collections import Counter

import pytest

from rangeflow.operators import extract
from rangeflow.params import ExtractParams
from rangeflow.sources import bam, genes, sam

AXES = [("chrA", 500_000), ("chrB", 300_000), ("chrC", 40_000)]
OPS = {c: i for i, c in enumerate(bam.CIGAR)}


def alignments(n=3000, seed=1):
    """(qname, flag, axis number, pos, mapq, cigar, mate axis number, mate pos) in file order."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        axis = rng.randrange(3)
        cigar = rng.choice([[(50, "M")], [(5, "S"), (40, "M"), (2, "D"), (3, "I"), (10, "M")], [(20, "M"), (100, "N"), (20, "=")]])
        flag = rng.choice([0, 16, 1024, 256, 1 + 64 + 32, 1 + 128 + 16])
        rows.append((f"q{k}", flag, axis, rng.randrange(1, AXES[axis][1]), rng.randrange(61), cigar, rng.randrange(3) if flag & 1 else -1, rng.randrange(1, 300) if flag & 1 else 0))
    return sorted(rows, key=lambda r: (r[2], r[3])) + [("lost", 4, -1, 0, 0, [], -1, 0)]


def expected(rows, library):
    name = lambda a: AXES[a][0] if a >= 0 else None
    length = lambda cigar: sum(n for n, c in cigar if c in "MDN=X")
    return Counter((library, q, f, name(a), p, m, length(c), name(b), mp) for q, f, a, p, m, c, b, mp in rows)


def sam_text(rows):
    head = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in AXES)
    name = lambda a, own=None: "*" if a < 0 else "=" if a == own else AXES[a][0]
    return head + "".join(f"{q}\t{f}\t{name(a)}\t{p}\t{m}\t{''.join(f'{n}{o}' for n, o in c) or '*'}\t{name(b, a)}\t{mp}\t0\t*\t*\n" for q, f, a, p, m, c, b, mp in rows)


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, rows, size=1000, index=False):
    """A block-compressed file with blocks of size bytes, records crossing their ends; its index names places in stretches of 16 Ki."""
    data = b"BAM\x01" + struct.pack("<ii", 0, len(AXES))
    for n, length in AXES:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
    starts = []
    for q, f, a, p, m, c, b, mp in rows:
        starts.append(len(data))
        body = struct.pack("<iiBBHHHiiii", a, p - 1, len(q) + 1, m, 0, len(c), f, 0, b, mp - 1, 0) + q.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS[o]) for n, o in c)
        data += struct.pack("<i", len(body)) + body
    out, places = b"", {}
    for at in range(0, len(data), size):
        places[at] = len(out)
        out += block(data[at : at + size])
    path.write_bytes(out + block(b""))
    if index:
        offset = lambda s: places[s - s % size] << 16 | s % size
        text = b"BAI\x01" + struct.pack("<i", len(AXES))
        ends = [*starts[1:], len(data)]
        for a, (_, length) in enumerate(AXES):
            linear, bins = [0] * (-(-length >> 14)), {}
            for s, e, r in zip(starts, ends, rows, strict=True):
                if r[2] == a:
                    lo, hi = r[3] - 1, max(r[3], r[3] - 1 + sum(n for n, c in r[5] if c in "MDN=X")) - 1
                    number = next((first + (lo >> shift) for shift, first in bam.BIN_LEVELS if lo >> shift == hi >> shift), 0)
                    bins.setdefault(number, []).append((offset(s), offset(e) if e < len(data) else len(out) << 16))
                    for k in range(lo >> 14, min(hi >> 14, len(linear) - 1) + 1):
                        linear[k] = linear[k] or offset(s)
            text += struct.pack("<i", len(bins))
            for number, chunks in bins.items():
                text += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks)
            text += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
        path.with_suffix(".bam.bai").write_bytes(text)


def test_sam_text(spark, tmp_path):
    rows = alignments(200)
    (tmp_path / "one.sam").write_text(sam_text(rows))
    (tmp_path / "two.sam").write_text(sam_text(rows[:50]).replace("LN:500000", "LN:400000").replace("@SQ\tSN:chrC\tLN:40000\n", ""))
    got = sam.read_sam(spark, str(tmp_path / "*.sam"))
    assert Counter(map(tuple, got.collect())) == expected(rows, "one") + expected(rows[:50], "two")
    assert {r["library"] for r in sam.read_sam(spark, str(tmp_path / "one.sam"), "mine").collect()} == {"mine"}
    with pytest.warns(UserWarning, match="axis lengths differ"):
        axes = sam.axis_catalog(sam.read_sam_axes(spark, str(tmp_path / "*.sam"))).orderBy("ord").collect()
    assert [tuple(r) for r in axes] == [("chrA", 400_000, 1), ("chrB", 300_000, 2)]
    one = sam.axis_catalog(sam.read_sam_axes(spark, str(tmp_path / "one.sam")), restrict=("chrB", "unknown")).collect()
    assert [tuple(r) for r in one] == [("chrB", 300_000, 1)]
    assert sam.leftover_count(got, ("chrA", "chrB", "chrC")) == 1


@pytest.mark.parametrize("index", [False, True])
def test_bam(spark, tmp_path, index):
    rows = alignments()
    write_bam(tmp_path / "lib.bam", rows, index=index)
    spark.dataSource.register(bam.BamDataSource)
    got = spark.read.format("bam").option("partitionBytes", 4000).load(str(tmp_path / "lib.bam"))
    assert Counter(map(tuple, got.collect())) == expected(rows, "lib")
    assert got.rdd.getNumPartitions() > 5
    assert bam.bam_axes([str(tmp_path / "lib.bam")]) == [(str(tmp_path / "lib.bam"), n, size) for n, size in AXES]


@pytest.mark.parametrize("index", [False, True])
def test_bam_of_some_axes(spark, tmp_path, index):
    rows = alignments()
    write_bam(tmp_path / "lib.bam", rows, index=index)
    spark.dataSource.register(bam.BamDataSource)
    load = lambda **options: spark.read.format("bam").options(partitionBytes=4000, **options).load(str(tmp_path / "lib.bam"))
    got = load(chroms="chrB")
    assert Counter(map(tuple, got.filter("mapq >= 30").collect())) == expected([r for r in rows if r[2] == 1 and r[4] >= 30], "lib")
    assert got.count() == sum(r[2] == 1 for r in rows)
    assert not index or got.rdd.getNumPartitions() < load().rdd.getNumPartitions() / 2
    assert load(chroms="none").count() == 0


@pytest.mark.parametrize("size", [70, 1000, 60_000])
@pytest.mark.parametrize("cut", [997, 5000])
def test_bam_without_index_is_cut_anywhere(tmp_path, size, cut):
    """Blocks smaller than a record, and cuts anywhere: each record is in one slice."""
    rows = alignments(700)
    write_bam(tmp_path / "lib.bam", rows, size=size)
    reader = bam.BamReader({"path": str(tmp_path / "lib.bam"), "partitionBytes": cut})
    slices = reader.partitions()
    assert len(slices) == -(-(tmp_path / "lib.bam").stat().st_size // cut)
    got = [tuple(r.values()) for s in slices for batch in reader.read(s) for r in batch.to_pylist()]
    assert Counter(got) == expected(rows, "lib") and len(got) == len(rows)


@pytest.mark.parametrize("index", [False, True])
@pytest.mark.parametrize("region,axis,start,end", [("chrA:100000-120000", 0, 100_000, 120_000), ("chrB", 1, 1, 300_000), ("chrB:299990-999999", 1, 299_990, 300_000), ("chrC:0-1", 2, 1, 1)])
def test_bam_region(tmp_path, index, region, axis, start, end):
    rows = alignments()
    write_bam(tmp_path / "lib.bam", rows, index=index)
    reader = bam.BamReader({"path": str(tmp_path / "lib.bam"), "partitionBytes": 4000, "region": region})
    got = Counter(tuple(r.values()) for s in reader.partitions() for batch in reader.read(s) for r in batch.to_pylist())
    inside = [r for r in rows if r[2] == axis and r[3] <= end and r[3] + max(1, sum(n for n, c in r[5] if c in "MDN=X")) > start]
    assert got == expected(inside, "lib")


def test_bam_region_reads_only_its_blocks(tmp_path):
    write_bam(tmp_path / "lib.bam", alignments(), index=True)
    reader = bam.BamReader({"path": str(tmp_path / "lib.bam"), "region": "chrA:100000-120000"})
    read = sum((s.end >> 16) - (s.start >> 16) for s in reader.partitions())
    assert 0 < read < (tmp_path / "lib.bam").stat().st_size / 8


@pytest.mark.parametrize("region,message", [("chrX", "unknown axis"), ("chrA:200-100", "behind its end"), ("chrC:50000-60000", "behind its end")])
def test_bam_region_is_refused(tmp_path, region, message):
    write_bam(tmp_path / "lib.bam", alignments(100), index=True)
    with pytest.raises(ValueError, match=message):
        bam.BamReader({"path": str(tmp_path / "lib.bam"), "region": region}).partitions()


def test_damaged_bam_is_refused(spark, tmp_path):
    write_bam(tmp_path / "bad.bam", alignments(100))
    data = bytearray((tmp_path / "bad.bam").read_bytes())
    data[len(data) // 2] ^= 1
    (tmp_path / "bad.bam").write_bytes(data)
    spark.dataSource.register(bam.BamDataSource)
    with pytest.raises(Exception, match="checksum|block|decompress"):
        spark.read.format("bam").load(str(tmp_path / "bad.bam")).collect()


def test_mates_and_axes_are_chosen(spark, tmp_path):
    rows = alignments(400)
    (tmp_path / "r.sam").write_text(sam_text(rows))
    reads = sam.read_sam(spark, str(tmp_path / "r.sam"))
    named = lambda params: {r["qname"] for r in extract.single_reads(reads, params).collect()}
    fine = [r for r in rows if not r[1] & (4 | 256) and r[2] >= 0]
    assert named(ExtractParams(pe="first")) == {r[0] for r in fine if r[1] & 65 == 65}
    assert named(ExtractParams(pe="second")) == {r[0] for r in fine if r[1] & 129 == 129}
    assert named(ExtractParams(restrict=("chrB",))) == {r[0] for r in fine if r[2] == 1}


def test_gtf(spark, tmp_path):
    lines = ["# a comment"]
    for g, strand, start in (("g1", "+", 100), ("g2", "-", 900)):
        tag = f'gene_id "{g}"; transcript_id "t{g}";' + (' gene_name "One";' if g == "g1" else "")
        lines += [f"chrA\tx\ttranscript\t{start}\t{start + 499}\t.\t{strand}\t.\t{tag}", f"chrA\tx\texon\t{start}\t{start + 99}\t.\t{strand}\t.\t{tag}", f"chrA\tx\texon\t{start + 300}\t{start + 499}\t.\t{strand}\t.\t{tag}"]
    (tmp_path / "m.gtf").write_text("\n".join(lines) + "\n")
    exons, transcripts, symbols = genes.read_gtf(spark, str(tmp_path / "m.gtf"))
    assert Counter(map(tuple, exons.collect())) == Counter([("g1", "chrA", 100, 199, "+"), ("g1", "chrA", 400, 599, "+"), ("g2", "chrA", 900, 999, "-"), ("g2", "chrA", 1200, 1399, "-")])
    axes = spark.createDataFrame([("chrA", 1500)], "chrom string, length int")
    assert Counter(map(tuple, genes.promoters(transcripts, axes, 300, 50).collect())) == Counter([("g1", "chrA", 1, 149, "+"), ("g2", "chrA", 1350, 1500, "-")])
    assert [tuple(r) for r in symbols.collect()] == [("g1", "One")]
