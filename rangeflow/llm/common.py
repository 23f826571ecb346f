"""Helpers shared by the training-data operators: shared tables, column names, vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

MASK64 = (1 << 64) - 1
BLOCK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared folder ---------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="rangeflow-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/_rangeflow"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rangeflow-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way, in one folder of the shared one, so that they can be deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, new_path(spark, name), []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}-{name}")
        return stored(df, name, self.paths[-1])

    def clear(self, *kept: str) -> None:
        """Deletes all tables but those of the names kept, which the operator's result still reads."""
        for path in self.paths:
            if path.rpartition("/")[2].partition("-")[2] not in kept:
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# -- Python workers --------------------------------------------------------------------------------

#: Bytes of the batches that Python workers get, unless the session sets its own.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes where they aren't: ten thousand long texts could fill a worker."""
    if _BATCHES not in spark.conf.getAll:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release_memory() -> None:
    """Gives memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _released(batches):
    """The batches; then memory is released, as the worker waits for other tasks."""
    yield from batches
    release_memory()


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, by workers that have this package and hand back their memory."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: _released(function(batches)), schema)


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def unit_hash(*columns: Column, seed: str) -> Column:
    """A reproducible number in (0, 1) from the columns' text: 52 bits of their MD5 and a half."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(1 << 52)


# -- byte classes ----------------------------------------------------------------------------------


def _classes(keep) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        low = byte + 32 if 0x41 <= byte <= 0x5A else byte
        if keep(low):
            table[byte] = low
    return table


#: byte -> lower-cased byte, 0 where the byte separates words
NON_SPACE = _classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
NON_SPACE[0] = 0xFF  # NUL is a word character there; 0xFF never occurs in UTF-8
ALPHANUMERIC = _classes(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39)
LETTERS = _classes(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


# -- Arrow text blocks -----------------------------------------------------------------------------


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, end row, bytes, row offsets into the bytes) for runs of rows of about limit bytes.

    A row longer than the limit makes a block of its own; null rows have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


# -- word hashes -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, MASK64, 256, np.uint64, endpoint=True)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def word_bounds(classes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-zero classes, cut where a row begins."""
    inside = classes != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offs[:-1][offs[:-1] < len(classes)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of classes[starts[i]:ends[i]], by differences of a running polynomial sum."""
    powers, inverses = _power_tables(len(classes) + 1)
    sums = np.zeros(len(classes) + 1, np.uint64)
    np.cumsum(_CODES[classes] * powers[: len(classes)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverses[starts])


def word_hashes(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each row the index of its first word (rows + 1 entries).

    A word's hash depends on its lower-cased bytes only. Very long rows are taken in pieces cut
    between words, so the working memory stays near a block's.
    """
    starts_all, hashes_all = [], []
    at, n = 0, len(raw)
    while at < n:
        end = min(at + 2 * BLOCK_BYTES, n)
        if end < n:  # cut before a separator or a row's first byte, else after the running word
            gaps = np.flatnonzero(table[raw[at:end]] == 0)
            rows = offs[(offs > at) & (offs < end)] - at
            best = max(gaps[-1] + 1 if len(gaps) else 0, rows[-1] if len(rows) else 0)
            while not best and end < n:
                more = np.flatnonzero(table[raw[end : end + BLOCK_BYTES]] == 0)
                if len(more):
                    best = end - at + int(more[0]) + 1
                end = min(end + BLOCK_BYTES, n)
            end = at + int(best) if best else n
        part = table[raw[at:end]]
        local = np.clip(offs, at, end) - at
        starts, ends = word_bounds(part, local)
        hashes_all.append(hash_spans(part, starts, ends))
        starts_all.append(starts + at)
        at = end
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes_all) if hashes_all else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offs, "left")


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], 0 for empty segments."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


def keep_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns, whatever they are called, can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
