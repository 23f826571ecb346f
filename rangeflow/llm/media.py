"""Media columns: PNG images in a binary column, decoded chunk by chunk, with cosine-transform hashes.

encode_png() stores bytes losslessly as an 8-bit greyscale PNG; decode_png() walks the chunks, tests
every checksum, inflates the image data and undoes the five row filters with numpy. The feature is a
perceptual hash: the image is averaged down to a square, transformed by a 2-D cosine transform, and
each of the low frequencies gives a bit, above or below their median.

Defined cases: a null or empty text has the payload of one block of padding; equal texts give equal
values; equal rows are separate rows; an empty table gives an empty table; only the named columns
are read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stored

#: Payloads are padded with PAD to squares of SIDE x SIDE samples, one below the other.
SIDE, PAD, LOW = 24, 255, 8
BLOCK = SIDE * SIDE
#: Fixed value of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 5
IDAT_BYTES = 1 << 20
_SCHEMA = "doc_id bigint, n_bytes bigint, media binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(image: np.ndarray) -> bytes:
    """The image's rows, each behind its filter type: none, sub or up, whichever has the least sum of signed sizes."""
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    choices = np.stack([image, image - left, image - above])
    cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = choices[best, np.arange(image.shape[0])]
    return out.tobytes()


def encode_png(payload: bytes, width: int = SIDE, adaptive: bool = True) -> bytes:
    """payload, a positive multiple of width long, as an 8-bit greyscale PNG.

    adaptive chooses a filter for each row by the least sum of signed sizes; else rows have none.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, image.shape[0], 8, 0, 0, 0, 0)
    packer, packed = zlib.compressobj(LEVEL), []
    for lo in range(0, image.shape[0], 1024):  # an overlapping row for the filters that look up
        if adaptive:
            rows = filter_rows(image[max(lo - 1, 0) : lo + 1024])[(width + 1) * (lo > 0) :]
        else:
            rows = np.pad(image[lo : lo + 1024], ((0, 0), (1, 0))).tobytes()
        packed.append(packer.compress(rows))
    data = b"".join(packed) + packer.flush()
    body = b"".join(_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """The image from rows of a filter type and filtered bytes, one byte a pixel.

    Rows without a filter are copied, "sub" rows are running sums along the row, runs of "up" rows
    running sums down the columns; "average" and "paeth" depend on the pixel to the left and go pixel
    by pixel.
    """
    kinds, data = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("PNG: unknown filter type")
    image = data.copy()
    sub = kinds == 1
    image[sub] = np.cumsum(data[sub], axis=1, dtype=np.uint8)
    zero = np.zeros(data.shape[1], np.uint8)
    up = np.concatenate([[False], kinds == 2, [False]])
    first, behind = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(up[:-1] & ~up[1:])
    ends = dict(zip(first.tolist(), behind.tolist(), strict=True))
    for y in np.flatnonzero((kinds > 2) | (up[1:-1] & ~up[:-2])).tolist():
        above = image[y - 1] if y else zero
        if kinds[y] == 2:
            image[y : ends[y]] = np.cumsum(data[y : ends[y]], axis=0, dtype=np.uint8) + above
            continue
        left = corner = 0
        line, up = data[y].tolist(), above.tolist()
        for x, value in enumerate(line):
            if kinds[y] == 3:
                guess = (left + up[x]) // 2
            else:
                p = left + up[x] - corner
                near = (abs(p - left), abs(p - up[x]), abs(p - corner))
                guess = left if near[0] <= near[1] and near[0] <= near[2] else up[x] if near[1] <= near[2] else corner
            left, corner = (value + guess) & 255, up[x]
            line[x] = left
        image[y] = line
    return image


def decode_png(media: bytes) -> np.ndarray:
    """The pixels of an 8-bit greyscale PNG; ValueError if it is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, size, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("PNG: it ends within a chunk")
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if len(body) < length or media[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("PNG: a chunk's checksum is wrong")
        at += 12 + length
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
            if size[2:] != (8, 0, 0, 0, 0):
                raise ValueError("PNG: only 8-bit greyscale without interlacing is read")
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("PNG: unknown critical chunk")
    if not size or not ended:
        raise ValueError("PNG: header or end is missing")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(rows) != size[1] * (size[0] + 1):
        raise ValueError("PNG: the image data has another length")
    return unfilter(rows.reshape(size[1], size[0] + 1))


@functools.cache
def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)).astype(np.float64)


@functools.cache
def _areas(n: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(SIDE + 1) * n // SIDE
    lo = np.minimum(edges[:-1], n - 1)
    return lo, np.maximum(edges[1:] - lo, 1)


def shrink(image: np.ndarray) -> np.ndarray:
    """SIDE x SIDE means over areas of the image; a dimension shorter than SIDE repeats its rows."""
    for _ in range(2):
        lo, size = _areas(image.shape[0])
        sums = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
        image = ((sums[lo + size] - sums[lo]) / size[:, None]).T
    return image


def low_frequency_hash(image: np.ndarray) -> str:
    """LOW x LOW bits in hex: each low frequency but the mean against the median of the others; the mean's bit is 0."""
    cosines = _cosines(SIDE, LOW)
    low = np.round((cosines @ shrink(image) @ cosines.T).ravel(), 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)


def _encode(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_png(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
            )


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _features(batches):
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part, rows = batch.slice(lo, 128), []
            for media in part.column(2):
                media = media.as_py()
                image = decode_png(media)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), low_frequency_hash(image)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)


def store_media(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, media): the texts' bytes as PNG, in a written table."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return stored(map_arrow(rows, _encode, _SCHEMA), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back: payload digests and the perceptual hash of each image."""
    return map_arrow(media.select("doc_id", "n_bytes", "media"), _features, _FEATURES)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
