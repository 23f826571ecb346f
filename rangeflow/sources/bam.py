"""BAM files as a Spark data source.

spark.dataSource.register(BamDataSource); spark.read.format("bam").load(path). A file with an index
(.bai) is cut at the record offsets of its linear index into partitions of about partitionBytes;
without one it is cut at bytes, and a partition begins with the first record after its first byte.
The option chroms, names with commas between, reads only the records and, with an index, the
partitions of these axes. The option region, name:start-end or a name, reads only the records that
overlap it and, with an index, only the chunks that may hold them; the region is clamped to its axis,
an unknown name or an empty region is an error. A folder that write_bam wrote is read like a file.
Filters aren't pushed down: Spark keeps them for a
frame's later queries, which would lose rows.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "library string, qname string, flag int, chrom string, pos int, mapq int, aln_len int, mate_chrom string, mate_pos int"
#: Fixed values of the format: CIGAR operations in code order, and those that use up the axis.
CIGAR, ON_AXIS = "MIDNSHP=X", frozenset("MDN=X")
#: Fixed values of the index: for each level of its bins, the bits that a place is shifted and the first bin; bin 0 holds everything.
BIN_LEVELS, LINEAR_SHIFT = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)), 14
#: Fixed values of the block compression: the first bytes of a block, and its greatest size.
MAGIC, BLOCK_LIMIT = b"\x1f\x8b\x08\x04", 1 << 16
PARTITION_BYTES = 64 << 20
#: A record's start is recognised by so many sound records in a row, each with at most so many bytes of tags.
CHAIN, TAG_BYTES = 8, 1 << 20
#: Records of a batch handed to Spark.
BATCH_ROWS = 8192
END = 1 << 63


#: The list of parts of a written folder.
MANIFEST = "_parts.json"


def store_of(path: str):
    """(file system, name on it) of a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _open(path: str):
    store, name = store_of(path)
    return store.open_input_file(name)


def _exists(path: str) -> bool:
    from pyarrow import fs

    store, name = store_of(path)
    return store.get_file_info(name).type == fs.FileType.File


def files_of(path: str) -> list[str]:
    """The files of a path: itself, or the listed parts of a written folder."""
    from pyarrow import fs

    store, name = store_of(path)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    folder = path.rstrip("/")
    if not _exists(f"{folder}/{MANIFEST}"):
        raise ValueError(f"{path} holds no written parts")
    with _open(f"{folder}/{MANIFEST}") as file:
        return [f"{folder}/{part}" for part in json.loads(file.read())["parts"]]


def library_of(path: str) -> str:
    """The name of a file, or of the written folder that it is a part of."""
    folder, _, name = path.rpartition("/")
    named = folder.rsplit("/", 1)[-1] if name.startswith("part-") and folder.endswith(".bam") else name
    return named.removesuffix(".bam")


def _size_in(extra: bytes) -> int | None:
    """The size of a block from its extra fields."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if kind == b"BC" and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    return None


class BlockReader:
    """Uncompressed bytes of a block-compressed file from a virtual offset on."""

    def __init__(self, file, offset: int = 0):
        self.file, self.block, self.data, self.at = file, offset >> 16, b"", offset & 0xFFFF
        self.next = self.block
        self._load()

    def _load(self) -> bool:
        self.block = self.next
        self.file.seek(self.block)
        head = self.file.read(12)
        if len(head) < 12:
            self.data = b""
            return False
        if head[:4] != MAGIC:
            raise ValueError("not a block-compressed file")
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        size = _size_in(extra)
        if size is None:
            raise ValueError("a block without its size")
        body = self.file.read(size - 12 - len(extra))
        self.data = zlib.decompress(body[:-8], -15)
        if zlib.crc32(self.data) != struct.unpack_from("<I", body, len(body) - 8)[0]:
            raise ValueError("a block's checksum is wrong")
        self.next = self.block + size
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte; END after the last."""
        while self.at >= len(self.data):
            self.at -= len(self.data)
            if not self._load():
                return END
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.data):
                self.at -= len(self.data)
                if not self._load():
                    break
            piece = self.data[self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out


def read_header(reader: BlockReader) -> list[tuple[str, int]]:
    """(name, length) of the axes."""
    if reader.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    reader.read(struct.unpack("<i", reader.read(4))[0])
    axes = []
    for _ in range(struct.unpack("<i", reader.read(4))[0]):
        name = reader.read(struct.unpack("<i", reader.read(4))[0])[:-1].decode()
        axes.append((name, struct.unpack("<i", reader.read(4))[0]))
    return axes


def block_after(file, at: int) -> int | None:
    """The place of the first block that starts at byte `at` or behind it; None after the last."""
    file.seek(at)
    data = file.read(3 * BLOCK_LIMIT)  # the block that holds the byte, and the two behind it
    place = data.find(MAGIC)
    while place >= 0:
        extra = struct.unpack_from("<H", data, place + 10)[0] if place + 12 <= len(data) else 0
        size = _size_in(data[place + 12 : place + 12 + extra])
        if size and data[place + size : place + size + 4] in (MAGIC, b""):
            return at + place
        place = data.find(MAGIC, place + 1)
    return None


def _sound(data: bytes, at: int, axes: list[tuple[str, int]]) -> int:
    """The size of the record that starts at `at`, 0 if none can start there."""
    size, ref, pos, name_size, _, _, ops, _, bases, mate_ref, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    for r, p in ((ref, pos), (mate_ref, mate_pos)):
        if not -1 <= r < len(axes) or p < -1 or r >= 0 and p > axes[r][1]:
            return 0
    least = 32 + name_size + 4 * ops + (bases + 1) // 2 + bases
    name = data[at + 36 : at + 36 + name_size]
    if bases < 0 or not least <= size <= least + TAG_BYTES or not name.endswith(b"\0") or not all(32 < c < 127 for c in name[:-1]):
        return 0
    cigar = data[at + 36 + name_size : at + 36 + name_size + 4 * ops : 4]
    return size + 4 if all(c & 15 < len(CIGAR) for c in cigar) else 0


def record_after(file, block: int, axes: list[tuple[str, int]]) -> int:
    """The virtual offset of the first record that starts in the block or behind it; END if there is none.

    A start is where a chain of sound records begins, or one that ends with the file.
    """
    reader = BlockReader(file, block << 16)
    data, places, more = reader.data, [(0, block)], True

    def load(upto: int) -> bool:
        nonlocal data, more
        while more and len(data) < upto:
            places.append((len(data), reader.next))
            more = reader._load()
            data += reader.data
        return len(data) >= upto

    def chained(at: int) -> bool:
        for _ in range(CHAIN):
            if not load(at + 36):
                return at == len(data)
            if not load(at + 36 + data[at + 12] + 4 * struct.unpack_from("<H", data, at + 16)[0]) or not (size := _sound(data, at, axes)):
                return False
            at += size
        return True

    at = 0
    while load(at + 36):
        # its name and operations may lie in the next block: chained() loads them
        if -1 <= struct.unpack_from("<i", data, at + 4)[0] < len(axes) and chained(at):
            start, of = places[bisect.bisect_right(places, (at, END)) - 1]
            return of << 16 | at - start
        at += 1
    return END


@dataclass
class AxisIndex:
    """An axis in the index: the chunks of its bins, and the first record offset for each stretch."""

    bins: dict[int, list[tuple[int, int]]]
    linear: list[int]

    def offsets(self) -> list[int]:
        return sorted({x for x in self.linear if x})

    def chunks(self, start: int, end: int) -> list[tuple[int, int]]:
        """Merged stretches of the file with all records that overlap start to end (from 1, both inside)."""
        lo, hi = start - 1, end - 1
        wanted = [0] + [b for shift, first in BIN_LEVELS for b in range(first + (lo >> shift), first + (hi >> shift) + 1)]
        before = self.linear[lo >> LINEAR_SHIFT] if lo >> LINEAR_SHIFT < len(self.linear) else 0
        found = sorted((max(a, before), b) for w in wanted for a, b in self.bins.get(w, ()) if b > before)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def read_index(data: bytes) -> list[AxisIndex]:
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        at, n_bins = at + 4, struct.unpack_from("<i", data, at)[0]
        for _ in range(n_bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            ends = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
            bins[number] = list(zip(ends[::2], ends[1::2], strict=True))
            at += 8 + 16 * chunks
        n = struct.unpack_from("<i", data, at)[0]
        out.append(AxisIndex(bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def record(data: bytes, axes: list[tuple[str, int]], library: str) -> tuple:
    ref, pos, name_size, mapq, _, ops, flag, _, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", data)
    qname = data[32 : 32 + name_size - 1].decode()
    cigar = struct.unpack_from(f"<{ops}I", data, 32 + name_size)
    length = sum(c >> 4 for c in cigar if CIGAR[c & 15] in ON_AXIS)
    name = lambda r: axes[r][0] if r >= 0 else None
    return library, qname, flag, name(ref), pos + 1, mapq, length, name(mate_ref), mate_pos + 1


def read_region(text: str) -> tuple[str, int | None, int | None]:
    """(name, start, end) of name:start-end, or of a name alone."""
    found = re.fullmatch(r"(.+):(\d+)-(\d+)", text)
    return (found[1], int(found[2]), int(found[3])) if found else (text, None, None)


def clamped(region: tuple[str, int | None, int | None], axes: list[tuple[str, int]]) -> tuple[str, int, int]:
    name, start, end = region
    length = dict(axes).get(name)
    if length is None:
        raise ValueError(f"unknown axis {name}")
    start, end = max(1, start or 1), min(length, end if end is not None else length)
    if start > end:
        raise ValueError(f"the region's start is behind its end or its axis: {name}:{region[1]}-{region[2]}")
    return name, start, end


@dataclass
class BamSlice(InputPartition):
    """Records that start between two virtual offsets or, in_bytes, in blocks that start between two bytes."""

    path: str
    start: int
    end: int
    in_bytes: bool

    def __init__(self, path: str, start: int, end: int, in_bytes: bool = False):
        self.path, self.start, self.end, self.in_bytes = path, start, end, in_bytes


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [file for path in options["path"].split(",") for file in files_of(path)]
        self.library = options.get("library")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.chroms = set(options["chroms"].split(",")) if options.get("chroms") else None
        self.region = read_region(options["region"]) if options.get("region") else None

    def _cut(self, path: str, start: int, end: int, offsets: list[int]) -> list[BamSlice]:
        """Slices from start to end of about partition_bytes, cut at record offsets."""
        out = []
        for o in offsets:
            if start < o < end and (o >> 16) - (start >> 16) >= self.partition_bytes:
                out.append(BamSlice(path, start, o))
                start = o
        return [*out, BamSlice(path, start, end)]

    def partitions(self):
        out = []
        for path in self.paths:
            with _open(path) as file:
                reader = BlockReader(file)
                axes = read_header(reader)
                first, size = reader.tell(), file.size()
            region = clamped(self.region, axes) if self.region else None
            index = next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if _exists(p)), None)
            if index is None:
                cuts = range(0, max(1, size), self.partition_bytes)
                out += [BamSlice(path, cut, min(cut + self.partition_bytes, size), True) for cut in cuts]
                continue
            with _open(index) as file:
                found = read_index(file.read())
            offsets = [a.offsets() for a in found]
            if region:
                of = [name for name, _ in axes].index(region[0])
                for start, end in found[of].chunks(*region[1:]) if of < len(found) else []:
                    out += self._cut(path, start, end, offsets[of])
                continue
            starts = [(o[0], name) for (name, _), o in zip(axes, offsets, strict=False) if o]
            for i, (_, name) in enumerate(starts):
                if self.chroms is not None and name not in self.chroms:
                    continue
                own = offsets[[a for a, _ in axes].index(name)]
                out += self._cut(path, own[0], starts[i + 1][0] if i + 1 < len(starts) else END, own)
            if not starts:
                out.append(BamSlice(path, first, END))
        return out or [BamSlice("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        library = self.library or library_of(partition.path)
        rows: list[tuple] = []
        with _open(partition.path) as file:
            head = BlockReader(file)
            axes = read_header(head)
            region = clamped(self.region, axes) if self.region else None
            start, end = partition.start, partition.end
            if partition.in_bytes:
                block = block_after(file, start)
                behind = block_after(file, end)
                end = END if behind is None else behind << 16
                start = head.tell() if not start else END if block is None or block << 16 >= end else record_after(file, block, axes)
            if start >= end:
                return
            reader = BlockReader(file, start)
            while (at := reader.tell()) < end and at != END:
                size = reader.read(4)
                if len(size) < 4:
                    break
                row = record(reader.read(struct.unpack("<i", size)[0]), axes, library)
                if (self.chroms is None or row[3] in self.chroms) and (region is None or row[3] == region[0] and row[4] <= region[2] and row[4] + max(row[6], 1) > region[1]):
                    rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32()}
    names, types = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def bam_axes(paths: list[str]) -> list[tuple[str, str, int]]:
    """(file, chrom, length) rows for axis_catalog."""
    out = []
    for path in paths:
        with _open(files_of(path)[0]) as file:
            out += [(path, name, length) for name, length in read_header(BlockReader(file))]
    return out
