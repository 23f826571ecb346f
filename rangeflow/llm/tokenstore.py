"""Token-id output in a content-addressed store.

Texts are encoded and cut into chunks where a rolling hash of the last ids says so, so equal
passages give equal chunks. The store is one Parquet table in ascending (doc_id) order with two kinds
of rows. A document row holds its recipe (the chunks' SHA-256 digests and lengths), the Merkle root
over them, and the ids of the chunks that occur nowhere else. A chunk row holds, once, a chunk that
occurs more than once. Reading joins shared chunks to the recipes and checks every digest and root.

File format: ids are little-endian unsigned integers of 16 bits (32 for vocabularies over 65,536);
digests are 32 bytes each, lengths and places unsigned 32-bit.

Defined cases: a null or empty text is the end id alone; equal rows are documents of their own, in
the table's order among equal doc_ids; null doc_ids come first; an empty table gives an empty store;
only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, NON_SPACE, Scratch, delete_path, hash_spans, map_arrow, new_path, read_table, stored, text_blocks, word_bounds

#: Chunk sizes in ids: at least, on average beyond that (a power of two), at most; rolling window.
LEAST, AVERAGE, MOST, ROLL = 64, 256, 2048, 8
#: Words whose ids a worker keeps, and the longest's bytes; when it has more, only the last run's stay.
CACHED_WORDS, CACHED_BYTES = 1_000_000, 64
DIGEST = 32
#: Marks that the vocabulary's pattern separates from a letter before them.
MARKS = b".,;:!?|%&$*#"
#: Bytes of text whose distinct words are found together.
RUN_BYTES = 4 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_IS_MARK = np.isin(np.arange(256), np.frombuffer(MARKS, np.uint8))


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _word_ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    out = np.zeros(_tokenizer(path).get_vocab_size(), bool)
    for token, number in _tokenizer(path).get_vocab().items():
        out[number] = token.endswith("</w>")
    return out


def id_type(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def encode_column(column: pa.Array, path: str, end_id: int):
    """(first row, end row, ids, bounds) of runs of rows: each row's ids and the end id, one after the other.

    White space always separates tokens in this vocabulary and case is folded, so words are encoded
    one by one: the distinct words of a run are found by their 64-bit hashes and looked up or encoded
    once, and the run's ids are gathered from theirs. Texts that may hold a special token's string
    are encoded as they are.
    """
    kind = np.dtype(id_type(path))
    for lo, hi, raw, offs in text_blocks(column, RUN_BYTES):
        starts, ends, first = _words(raw, offs)
        hashes = hash_spans(NON_SPACE[raw], starts, ends)
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) else starts[:0]
        lowered = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint8(32), raw).tobytes()
        kept = {}
        for row in np.unique(np.searchsorted(offs, special, "right") - 1).tolist():
            text = raw[offs[row] : offs[row + 1]].tobytes().decode("utf-8", "surrogatepass")
            kept[row] = np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, kind)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        flat, at_word, sizes = _word_table(path).look_up(distinct, lowered, starts[at], ends[at])
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at_word[which] - upto[:-1], n) + np.arange(upto[-1])] if len(n) else flat[:0]
        bounds = upto[first]
        if kept:
            parts = [kept.get(r, ids[bounds[r] : bounds[r + 1]]) for r in range(hi - lo)]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ids = np.insert(ids, bounds[1:], np.array(end_id, kind))
        yield lo, hi, ids, bounds + np.arange(len(bounds))


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first. Marks behind a letter are tokens of their own, so they are words too."""
    if not len(raw):
        return offs[:0], offs[:0], np.zeros(len(offs), np.int64)
    starts, ends = word_bounds(NON_SPACE[raw], offs)
    if not len(starts):
        return starts, ends, np.zeros(len(offs), np.int64)
    other = np.maximum.accumulate(np.where(_IS_MARK[raw], -1, np.arange(len(raw))))
    stops = np.maximum(other[ends - 1] + 1, starts)  # behind the last byte that isn't a mark
    cut = (stops > starts) & (stops < ends) & (LETTERS[raw[stops - 1]] != 0) & (raw[stops - 1] < 0x80)
    upto = np.concatenate([[0], np.cumsum(1 + cut)])
    first = upto[np.searchsorted(starts, offs)]
    starts, ends = np.repeat(starts, 1 + cut), np.repeat(ends, 1 + cut)
    marks = upto[1:][cut] - 1
    starts[marks], ends[marks - 1] = stops[cut], stops[cut]
    return starts, ends, first


class _WordTable:
    """The ids of words seen before, by the words' hashes: sorted hashes, and where each one's ids lie in one array."""

    def __init__(self, path: str):
        self.path, self.kind = path, np.dtype(id_type(path))
        self.hashes, self.at, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def look_up(self, hashes: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place, size) of words with these ascending hashes, which stand at these places of the text."""
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        short = ends[new] - starts[new] <= CACHED_BYTES
        new = np.concatenate([new[short], new[~short]])  # long ones last: they aren't kept
        n_short = int(short.sum())
        coded, new_sizes = _encode_words([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], self.path)
        flat = np.concatenate([self.ids, coded])
        at, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32)
        at[known], sizes[known] = self.at[place[known]], self.sizes[place[known]]
        at[new], sizes[new] = len(self.ids) + np.cumsum(new_sizes) - new_sizes, new_sizes
        if len(self.hashes) + n_short <= CACHED_WORDS:
            kept = new[:n_short]
            self.hashes, self.at, self.sizes = (np.insert(old, place[kept], more[kept]) for old, more in ((self.hashes, hashes), (self.at, at), (self.sizes, sizes)))
            self.ids = flat[: len(self.ids) + int(new_sizes[:n_short].sum())]
        else:
            kept = np.flatnonzero(ends - starts <= CACHED_BYTES)
            self.hashes, self.sizes = hashes[kept], sizes[kept]
            self.at = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            self.ids = flat[np.repeat(at[kept] - self.at, self.sizes) + np.arange(int(self.sizes.sum()))]
        return flat, at, sizes


@functools.cache
def _word_table(path: str) -> _WordTable:
    return _WordTable(path)


def _encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids, one word after the other, and each one's number of ids."""
    kind, last, encode = np.dtype(id_type(path)), _word_ends(path), _tokenizer(path)
    coded, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int32)]
    for lo in range(0, len(words), 4096):
        some = [w.decode("utf-8", "surrogatepass") for w in words[lo : lo + 4096]]
        # a word of letters alone is one unit of the vocabulary, whose last token carries the end mark:
        # such words are encoded in one text and its ids cut there
        alone = np.array([w.isalpha() for w in some])
        letters = [w for w, a in zip(some, alone.tolist(), strict=True) if a]
        ids = np.array(encode.encode(" ".join(letters), add_special_tokens=False).ids, kind)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(letters):  # a letter that the vocabulary's pattern takes otherwise
            alone[:], ids, ends = False, ids[:0], ends[:0]
        others = encode.encode_batch_fast([w for w, a in zip(some, alone.tolist(), strict=True) if not a], add_special_tokens=False)
        n = np.zeros(len(some), np.int32)
        n[alone], n[~alone] = np.diff(ends, prepend=0), [len(e.ids) for e in others]
        of_letters = np.repeat(alone, n)
        both = np.zeros(len(of_letters), kind)
        both[of_letters], both[~of_letters] = ids, [i for e in others for i in e.ids]
        coded.append(both)
        sizes.append(n)
    return np.concatenate(coded), np.concatenate(sizes)


def encode_texts(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    """Each text's ids and the end id, as bytes."""
    out = []
    for lo, hi, ids, bounds in encode_column(pa.array(texts, pa.string()), path, end_id):
        out += [ids[bounds[i] : bounds[i + 1]].tobytes() for i in range(hi - lo)]
    return out


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends within each document of the concatenated ids: where the rolling hash hits, within the limits."""
    codes = (ids.astype(np.uint64) + np.uint64(1)) * _SPREAD
    codes ^= codes >> np.uint64(29)
    roll = np.zeros(len(ids), np.uint64)
    for k in range(ROLL):  # hash over the ids i - ROLL + 1 .. i; no cut is allowed before LEAST > ROLL ids
        roll[k:] += codes[: len(codes) - k] * np.uint64(pow(int(_SPREAD), k + 1, 1 << 64))
    hits = np.flatnonzero((roll >> np.uint64(40)) & np.uint64(AVERAGE - 1) == 0) + 1
    out = []
    spans = np.searchsorted(hits, bounds)
    for d in range(len(bounds) - 1):
        at, end, cuts = int(bounds[d]), int(bounds[d + 1]), []
        for hit in hits[spans[d] : spans[d + 1]].tolist():
            while hit - at > MOST:
                at += MOST
                cuts.append(at)
            if hit - at >= LEAST:
                at = hit
                cuts.append(at)
        while end - at > MOST:
            at += MOST
            cuts.append(at)
        if at < end:
            cuts.append(end)
        out.append([c - int(bounds[d]) for c in cuts])
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairs are hashed together level by level; an odd last one moves up as it is."""
    level = digests
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


_STAGE = "rid bigint, doc_id bigint, n_tokens bigint, ids binary, ends binary, digests binary, root binary"


def _encode(batches, path: str, end_id: int):
    size = np.dtype(id_type(path)).itemsize
    for batch in batches:
        for lo, hi, ids, bounds in encode_column(batch.column(2), path, end_id):
            cuts, data = cut_points(ids, bounds), ids.tobytes()
            coded, digests = [], []
            for at, to, ends in zip((bounds[:-1] * size).tolist(), (bounds[1:] * size).tolist(), cuts, strict=True):
                places = [at, *(at + e * size for e in ends)]
                digests.append([hashlib.sha256(data[a:b]).digest() for a, b in zip(places, places[1:], strict=False)])
                coded.append(data[at:to])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(coded, pa.binary()), pa.array([np.array(e, "<u4").tobytes() for e in cuts], pa.binary()),
                 pa.array([b"".join(d) for d in digests], pa.binary()), pa.array([merkle_root(d) for d in digests], pa.binary())],
                [x.split()[0] for x in _STAGE.split(", ")],
            )


_PACK = "kind string, rid bigint, doc_id bigint, part int, before bigint, n_tokens bigint, own binary, ends binary, digests binary, root binary, shared binary, digest binary, chunk binary"


def _pack(batches, size: int):
    """Documents in order, each after its row of shared places; adds the number of ids before it in this partition."""
    part, before, shared = TaskContext.get().partitionId(), 0, None
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _PACK.split(", ")])
    for batch in batches:
        rows, held = [], 0
        for row in (r for lo in range(0, batch.num_rows, 256) for r in batch.slice(lo, 256).to_pylist()):
            if row["kind"] == 0:
                shared = (row["rid"], row["places"], row["owned"])
                continue
            places, owned = shared[1:] if shared and shared[0] == row["rid"] else ((), ())
            shared = None
            ids, own = row["ids"], row["ids"]
            if places:
                ends = [0, *(int(e) * size for e in np.frombuffer(row["ends"], "<u4"))]
                skip = set(places)
                own = b"".join([ids[ends[i] : ends[i + 1]] for i in range(len(ends) - 1) if i not in skip])
                for i in owned:
                    rows.append({"kind": "chunk", "digest": row["digests"][DIGEST * i : DIGEST * i + DIGEST], "chunk": ids[ends[i] : ends[i + 1]]})
            rows.append({"kind": "doc", "part": part, "before": before, "own": own, "shared": np.array(sorted(places), "<u4").tobytes()} | {k: row[k] for k in ("rid", "doc_id", "n_tokens", "ends", "digests", "root")})
            before += row["n_tokens"]
            held += len(ids)
            if held > 4 << 20 or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_store(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, folder: str) -> None:
    """Encodes docs into the store table at folder."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    staged, scratch = new_path(spark, "encoded"), Scratch(spark, "store")
    coded = map_arrow(texts, lambda it: _encode(it, tokenizer_path, end_id), _STAGE)
    coded.write.option("compression", "zstd").parquet(staged)
    stage = spark.read.schema(coded.schema).parquet(staged)
    place = F.posexplode(F.expr(f"transform(sequence(1, length(digests), {DIGEST}), i -> substring(digests, i, {DIGEST}))")).alias("place", "digest")
    places = scratch.stored(stage.select("rid", "doc_id", place), "places")
    shared = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("first")).filter("n > 1").select("digest", "first")
    # written first: the join can then split a digest that a large part of the places share
    shared = scratch.stored(shared, "shared")
    listed = places.join(shared, "digest").groupBy("doc_id", "rid").agg(
        F.collect_list("place").alias("places"), F.collect_list(F.when(F.struct("rid", "place") == F.col("first"), F.col("place"))).alias("owned")
    )
    listed = scratch.stored(listed, "shared-places")
    empty = "array<int>"
    rows = listed.select(F.lit(0).alias("kind"), "rid", "doc_id", "places", "owned").unionByName(
        stage.withColumns({"kind": F.lit(1), "places": F.lit(None).cast(empty), "owned": F.lit(None).cast(empty)}), allowMissingColumns=True
    )
    size = np.dtype(id_type(tokenizer_path)).itemsize
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "rid").sortWithinPartitions("doc_id", "rid", "kind")
    map_arrow(rows, lambda it: _pack(it, size), _PACK).write.option("compression", "zstd").parquet(folder)
    delete_path(spark, staged)
    scratch.clear()


def _verify(batches, kind: str):
    size = np.dtype(kind).itemsize
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256).to_pylist()
            crcs, payloads = [], []
            for row in part:
                ends = [0, *(int(e) * size for e in np.frombuffer(row["ends"], "<u4"))]
                fetched = {x["place"]: x["chunk"] for x in row["fetched"] or ()}
                chunks, at = [], 0
                for i in range(len(ends) - 1):
                    n = ends[i + 1] - ends[i]
                    if i in fetched:
                        chunks.append(fetched[i])
                    else:
                        chunks.append(row["own"][at : at + n])
                        at += n
                digests = [hashlib.sha256(c).digest() for c in chunks]
                if b"".join(digests) != row["digests"] or merkle_root(digests) != row["root"] or at != len(row["own"]):
                    raise ValueError(f"document {row['doc_id']} can't be rebuilt from its chunks")
                ids = b"".join(chunks)
                payloads.append(ids)
                crcs.append(zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes()))
            column = lambda k, t: pa.array([r[k] for r in part], t)
            yield pa.RecordBatch.from_arrays(
                [column("doc_id", pa.int64()), column("part", pa.int32()), column("before", pa.int64()), pa.array([len(p) // size for p in payloads], pa.int64()), pa.array(crcs, pa.int64()), pa.array(payloads, pa.binary())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32", "ids"],
            )


def read_store(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, rebuilt and verified."""
    table = spark.read.parquet(folder)
    docs = table.filter("kind = 'doc'").select("rid", "doc_id", "part", "before", "n_tokens", "own", "ends", "digests", "root", "shared")
    chunks = table.filter("kind = 'chunk'").select("digest", "chunk")
    # the places are little-endian: their four bytes in reverse are a number's hex digits
    digits = ", ".join(f"hex(substring(shared, i + {k}, 1))" for k in (3, 2, 1, 0))
    wanted = docs.filter("length(shared) > 0").select(
        "rid", "digests", F.explode(F.expr(f"transform(sequence(1, length(shared), 4), i -> cast(conv(concat({digits}), 16, 10) as int))")).alias("place")
    )
    wanted = wanted.select("rid", "place", F.expr(f"substring(digests, place * {DIGEST} + 1, {DIGEST})").alias("digest"))
    fetched = wanted.join(chunks, "digest").groupBy("rid").agg(F.collect_list(F.struct("place", "chunk")).alias("fetched"))
    whole = docs.filter("length(shared) = 0").withColumn("fetched", F.lit(None).cast("array<struct<place:int,chunk:binary>>"))
    joined = docs.filter("length(shared) > 0").join(fetched, "rid")
    rebuilt = map_arrow(whole.unionByName(joined).drop("rid", "shared"), lambda it: _verify(it, kind), "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    # a row for each partition of the store
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("ids_of"))
    parts = stored(parts.select("part", F.expr("coalesce(sum(ids_of) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("earlier")), "store-parts")
    return rebuilt.join(parts, "part").select("doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    folder = new_path(spark, "token-store")
    write_store(docs, id_col, text_col, tokenizer_path, end_id, folder)
    return read_store(spark, folder, id_type(tokenizer_path))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read_table(spark, sf_dir, "documents"), word_bpe_path()).drop("ids")
