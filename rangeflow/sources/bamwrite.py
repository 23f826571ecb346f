"""Sorted BAM output: a folder of parts, each a whole file with its index, and a list of the parts.

write_bam(reads, axes, "lib.bam") sorts by axis and place over all tasks. Every task writes its range
under a name of its own; the list is written last, from what the tasks reported, so that parts of
failed or repeated tasks are never read. The reader takes such a folder like a file, with its name as
the library. Reads have no operations, only the bases they take on the axis: these become one match.
Nulls: a name "*", flag 0, place 0, mapping quality 255, no axis.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..shipping import ship
from .bam import BIN_LEVELS, LINEAR_SHIFT, MAGIC, MANIFEST, SCHEMA, store_of

#: Uncompressed bytes of a block.
BLOCK_BYTES = 0xFF00
#: Fixed value of the format: the bin of records without a place.
UNPLACED_BIN = 4680
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class BlockWriter:
    """A block-compressed file; tell() gives the virtual offset of the next byte."""

    def __init__(self, file):
        self.file, self.at, self.buffer = file, 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.buffer)

    def write(self, data: bytes) -> None:
        self.buffer += data
        while len(self.buffer) >= BLOCK_BYTES:
            self._block(bytes(self.buffer[:BLOCK_BYTES]))
            del self.buffer[:BLOCK_BYTES]

    def _block(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        block = MAGIC + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
        self.file.write(block)
        self.at += len(block)

    def close(self) -> None:
        if self.buffer:
            self._block(bytes(self.buffer))
            self.buffer.clear()
        self._block(b"")  # the end of the file


def header(axes: list[tuple[str, int]]) -> bytes:
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in axes)).encode()
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(axes))
    for name, length in axes:
        out += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds start to end, from 0, both inside."""
    return next((first + (start >> shift) for shift, first in BIN_LEVELS if start >> shift == end >> shift), 0)


def record_bytes(row, refs: dict[str, int]) -> tuple[int, int, int, bytes]:
    """(axis number, first and last place from 0, the record)."""
    for chrom in (row.chrom, row.mate_chrom):
        if chrom is not None and chrom not in refs:
            raise ValueError(f"unknown axis {chrom}")
    name = (row.qname or "*").encode()
    if len(name) > 254:
        raise ValueError("a name has more than 254 bytes")
    ref, start, length = refs.get(row.chrom, -1), (row.pos or 0) - 1, row.aln_len or 0
    last = start + max(length, 1) - 1
    cigar = struct.pack("<I", length << 4) if length else b""
    fields = ref, start, len(name) + 1, 255 if row.mapq is None else row.mapq, bin_of(start, last) if start >= 0 else UNPLACED_BIN, bool(length), row.flag or 0, 0, refs.get(row.mate_chrom, -1), (row.mate_pos or 0) - 1, 0
    body = struct.pack("<iiBBHHHiiii", *fields) + name + b"\0" + cigar
    return ref, start, last, struct.pack("<i", len(body)) + body


class IndexWriter:
    """The index of a sorted file, gathered record by record."""

    def __init__(self, axes: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(axes)]
        self.linear: list[list[int]] = [[] for _ in range(axes)]

    def add(self, ref: int, start: int, last: int, begin: int, end: int) -> None:
        if ref < 0 or start < 0:
            return
        chunks = self.bins[ref].setdefault(bin_of(start, last), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        linear, upto = self.linear[ref], last >> LINEAR_SHIFT
        linear += [0] * (upto + 1 - len(linear))
        for k in range(start >> LINEAR_SHIFT, upto + 1):
            linear[k] = linear[k] or begin

    def data(self) -> bytes:
        out = [b"BAI\x01", struct.pack("<i", len(self.bins))]
        for bins, linear in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks))
            out.append(struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear))
        return b"".join(out)


@dataclass
class Written(WriterCommitMessage):
    part: str
    records: int


class BamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_parts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BamWriter(self.options["path"].rstrip("/"), json.loads(self.options["axes"]))


class BamWriter(DataSourceWriter):
    def __init__(self, path: str, axes: list[tuple[str, int]]):
        self.path, self.axes = path, axes

    def write(self, iterator):
        refs = {name: i for i, (name, _) in enumerate(self.axes)}
        part, records, index, before = f"part-{uuid.uuid4().hex}.bam", 0, IndexWriter(len(self.axes)), None
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{part}") as file:
            out = BlockWriter(file)
            out.write(header(self.axes))
            for row in iterator:
                ref, start, last, data = record_bytes(row, refs)
                place = (ref < 0, ref, start)
                if before is not None and place < before:
                    raise ValueError("the records are not sorted")
                before, begin, records = place, out.tell(), records + 1
                out.write(data)
                index.add(ref, start, last, begin, out.tell())
            out.close()
        with store.open_output_stream(f"{folder}/{part}.bai") as file:
            file.write(index.data())
        return Written(part, records)

    def commit(self, messages):
        store, folder = store_of(self.path)
        parts = sorted(m.part for m in messages if m is not None and m.records)
        parts = parts or sorted(m.part for m in messages if m is not None)[:1]  # a file without records still has its axes
        with store.open_output_stream(f"{folder}/{MANIFEST}") as file:
            file.write(json.dumps({"parts": parts, "records": sum(m.records for m in messages if m is not None)}).encode())

    def abort(self, messages):
        store, folder = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.part}")
                store.delete_file(f"{folder}/{m.part}.bai")


def write_bam(reads: DataFrame, axes: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes the reads of one library, sorted, to the folder path, which must not hold a written one; axes(chrom, length, ord) is a row for each axis."""
    spark = reads.sparkSession
    store, folder = store_of(path.rstrip("/"))
    from pyarrow import fs

    if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
        raise ValueError(f"{path} is already written")
    ship(spark)
    spark.dataSource.register(BamSink)
    named = [(r["chrom"], r["length"]) for r in axes.orderBy("ord").collect()]
    placed = reads.join(F.broadcast(axes.select("chrom", F.col("ord").alias("_ord"))), "chrom", "left")  # a row for each axis
    order = [F.col("_ord").asc_nulls_last(), F.col("pos").asc_nulls_first()]
    # equal places may be many: the name deals them over parts
    ranged = placed.repartitionByRange(parts, *order, "qname") if parts else placed.repartitionByRange(*order, "qname")
    ranged.sortWithinPartitions(*order, "qname", "flag").select(*COLUMNS).write.format("bam_parts").option("axes", json.dumps(named)).mode("append").save(path)
