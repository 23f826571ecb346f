"""Benchmark decontamination by suffix arrays over the training documents.

Every task cuts its documents into shards of a bounded number of words, builds each shard's suffix
array (order of the suffixes by their leading words, by rank doubling) and binary-searches the
windows of every benchmark suffix in it, each different window once. What an occurrence covers is
marked by sums of differences, so a place costs the same however many windows meet there. The runs
that windows cover are then ordered together with the texts they come from, which gives the longest
verbatim match from each word on, and its place. The benchmark is broadcast in blocks of a checked size.

Defined cases: null texts and texts without words have no windows and no hits; an item with fewer
words than a window is one window; equal rows are separate documents; equal items are one text with
several ids, of which a match names the first; items with a null id count as the id "" in the digest;
empty tables give empty results or no hits; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, map_arrow, mix64, read_table, stored, text_blocks, word_hashes

WINDOW = 10
SHARD_WORDS = 400_000
#: A broadcast block of the benchmark: texts of at most so many bytes (a larger item is a block of its own).
BLOCK_TEXT_BYTES = 16 << 20

SCHEMA = "rid bigint, doc_id bigint, n_words bigint, hit_start array<bigint>, hit_end array<bigint>, items array<bigint>, match_item array<bigint>, match_at array<bigint>, match_words array<bigint>"


class SuffixArray:
    """The suffixes of a shard's words, ordered by their leading words to any depth asked for.

    ranks[k] holds, for each place, the rank of its 2**k words; keys of other lengths combine two.
    """

    def __init__(self, words: np.ndarray, deepest: int):
        self.words, self.tables, self.ranks = words, [], []
        table, rank = np.unique(words, return_inverse=True)
        while True:
            self.tables.append(table)
            self.ranks.append(rank.astype(np.int64))
            step = 1 << (len(self.ranks) - 1)
            if 2 * step > deepest or 2 * step > len(words):
                break
            last = self.ranks[-1]
            table, rank = np.unique(last[:-step] * len(table) + last[step:], return_inverse=True)

    def lookup(self, words: np.ndarray) -> list[np.ndarray]:
        """ranks of other words by binary search; -1 where the shard has no such words."""
        out = []
        for k, table in enumerate(self.tables):
            if k == 0:
                keys, known = words, np.ones(len(words), bool)
            else:
                step, last = 1 << (k - 1), out[-1]
                if len(last) <= step:
                    break
                keys = last[:-step] * len(self.tables[k - 1]) + last[step:]
                known = (last[:-step] >= 0) & (last[step:] >= 0)
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            out.append(np.where(known & (table[at] == keys), at, -1))
        return out

    def find(self, found: list[np.ndarray], starts: np.ndarray, length: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, place) of all occurrences of length words; ends: of each place's document.

        Different windows have different stretches of the array, so with distinct starts no place comes twice.
        """
        k = length.bit_length() - 1
        rest = length - (1 << k)
        none = np.zeros(0, np.int64)
        if len(self.ranks) <= k or len(self.words) < length or len(found) <= k:
            return none, none
        rank, size = self.ranks[k], len(self.tables[k])
        first, second = found[k][starts], found[k][starts + rest]
        there = np.flatnonzero((first >= 0) & (second >= 0))
        if not len(there):
            return none, none
        keys = rank[: len(self.words) - length + 1] * size + rank[rest : rest + len(self.words) - length + 1]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        wanted = first[there] * size + second[there]
        lo, hi = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
        counts = hi - lo
        which = np.repeat(there, counts)
        places = order[np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        inside = places + length <= ends[places]
        return which[inside], places[inside]


def ragged(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into rows, value) of the lists values[bounds[r]:bounds[r + 1]] of rows, one after the other."""
    sizes = bounds[rows + 1] - bounds[rows]
    return np.repeat(np.arange(len(rows)), sizes), values[np.repeat(bounds[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Benchmark:
    """A block of items: its different texts as word hashes, their ids, and the different windows to be searched.

    windows has, for each length, the first place of every different window and the window's number.
    Windows that stand in the same texts share a list of texts.
    """

    def __init__(self, ids: list, texts: list, window: int):
        self.window = window
        parts, seen, owners = [], {}, []
        for lo, hi, raw, offs in text_blocks(pa.array(texts, pa.string())):
            hashes, first = word_hashes(raw, offs, ALPHANUMERIC)
            for i in range(lo, hi):
                own = hashes[first[i - lo] : first[i - lo + 1]]
                if len(own):
                    number = seen.setdefault(own.tobytes(), len(seen))
                    if number == len(parts):
                        parts.append(own)
                        owners.append([])
                    owners[number].append(ids[i])
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        self.ids = [x for own in owners for x in own]
        self.id_bounds = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists: dict[bytes, int] = {}
        sizes, list_of = np.diff(self.bounds), []
        for length in sorted({min(window, int(x)) for x in sizes}):
            items = np.flatnonzero(np.minimum(sizes, window) == length)
            starts = [np.arange(self.bounds[i], self.bounds[i + 1] - length + 1) if sizes[i] >= window else self.bounds[i : i + 1] for i in items]
            starts, item_of = np.concatenate(starts), np.repeat(items, [len(s) for s in starts])
            hashes = np.zeros(len(starts), np.uint64)
            for k in range(length):
                hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + self.words[starts + k])
            _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            self.windows[length] = starts[at], len(list_of) + np.arange(len(at))
            pairs = np.unique(which * len(sizes) + item_of)
            cuts = np.searchsorted(pairs // len(sizes), np.arange(len(at) + 1))
            texts_of = pairs % len(sizes)
            list_of += [lists.setdefault(texts_of[x:y].tobytes(), len(lists)) for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        self.list_of = np.array(list_of, np.int64)
        members = [np.frombuffer(x, np.int64) for x in lists]
        self.texts_of = np.concatenate(members) if members else np.zeros(0, np.int64)
        self.list_bounds = np.concatenate([[0], np.cumsum([len(x) for x in members])]).astype(np.int64)


def search(words: np.ndarray, ends: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, words) of all occurrences of the benchmark's windows: at most one a place and length."""
    none = np.zeros(0, np.int64)
    if not len(words) or not bench.windows:
        return none, none, none
    array = SuffixArray(words, max(bench.windows))
    found = array.lookup(bench.words)
    out = []
    for length, (starts, numbers) in bench.windows.items():
        which, places = array.find(found, starts, length, ends)
        out.append((numbers[which], places, np.full(len(which), length)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def longest_matches(runs: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the runs: how many words from it on stand somewhere in texts, and in which.

    Runs and texts get one suffix array, whose ranks by 1, 2, 4, ... words are kept. The longest match
    is that with the nearest text suffix before or behind in the order; its length comes from the ranks.
    """
    parts, owner = [], []
    for number, part in enumerate([*runs, *texts]):
        parts += [part, np.zeros(1, np.uint64)]
        owner.append(np.full(len(part) + 1, number))
    owner = np.concatenate(owner)
    words = np.concatenate(parts)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64)
    cuts = np.cumsum([len(p) + 1 for p in [*runs, *texts]]) - 1
    rank[cuts] = rank.max() + 1 + np.arange(len(cuts))  # each end differs from everything
    n, ranks, step = len(words), [rank], 1
    while step < max(map(len, runs)):
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = ranks[-1][step:] + 1
        _, rank = np.unique(ranks[-1] * (int(ranks[-1].max()) + 2) + behind, return_inverse=True)
        ranks.append(rank.astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    is_text = owner[order] >= len(runs)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(is_text, at, -1))
    after = np.minimum.accumulate(np.where(is_text, at, n)[::-1])[::-1]
    mine = np.flatnonzero(~is_text)
    best, text = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for near in (before[mine], after[mine]):
        there = (near >= 0) & (near < n)
        x, y = order[mine[there]], order[near[there]]
        same = np.zeros(len(x), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            a, b = x + same, y + same
            inside = (a < n) & (b < n)
            equal = np.zeros(len(x), bool)
            equal[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            same += equal * (1 << k)
        longer = same > best[x]
        best[x[longer]], text[x[longer]] = same[longer], owner[y[longer]] - len(runs)
    keep = owner < len(runs)
    keep[cuts] = False
    return best[keep], text[keep]


def _shards(bounds: np.ndarray, overlap: int):
    """(first row, end row, first word, end word): runs of whole rows, or overlapping pieces of one long row."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = int(np.searchsorted(bounds, bounds[row] + SHARD_WORDS, "right")) - 1
        if end > row:
            yield row, end, bounds[row], bounds[end]
            row = end
            continue
        for at in range(int(bounds[row]), int(bounds[row + 1]), SHARD_WORDS):
            yield row, row + 1, at, min(at + SHARD_WORDS + overlap, bounds[row + 1])
        row += 1


def _matches(words: np.ndarray, row_of: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, words) of the longest verbatim matches that begin where none before goes as far."""
    window, place, size = hits
    full = size == bench.window
    _, texts = ragged(bench.texts_of, bench.list_bounds, bench.list_of[window])
    out = [(place[~full], bench.texts_of[bench.list_bounds[bench.list_of[window[~full]]]], size[~full])]
    if full.any():
        starts, ends = _runs(_covered(place[full], size[full], len(words)), row_of)
        texts = np.unique(texts)
        length, text = longest_matches([words[a:b] for a, b in zip(starts, ends, strict=True)], [words_of for words_of in (bench.words[bench.bounds[t] : bench.bounds[t + 1]] for t in texts)])
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
        before = np.concatenate([[0], length[:-1]])
        before[np.concatenate([[0], np.cumsum(ends - starts)[:-1]])] = 0
        new = np.flatnonzero((length >= bench.window) & (length >= before))
        out.append((at[new], texts[text[new]], length[new]))
    place, text, size = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((text, size, place))
    return place[order], text[order], size[order]


def _covered(place: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    change = np.bincount(place, minlength=n + 1) - np.bincount(place + size, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def _runs(covered: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the covered runs, cut between rows."""
    joined = covered[1:] & covered[:-1] & (row_of[1:] == row_of[:-1])
    return np.flatnonzero(covered & ~np.concatenate([[False], joined])), np.flatnonzero(covered & ~np.concatenate([joined, [False]])) + 1


def _searched(batches, bench: Benchmark, column: int):
    """(rows of a block, word bounds of the rows, words, row of each word, occurrences of windows)"""
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(column)):
            words, bounds = word_hashes(raw, offs, ALPHANUMERIC)
            row_of = np.repeat(np.arange(hi - lo), np.diff(bounds))
            found = [(np.zeros(0, np.int64),) * 3]
            for _, _, w0, w1 in _shards(bounds, bench.window - 1):
                window, place, size = search(words[w0:w1], np.minimum(bounds[row_of[w0:w1] + 1], w1) - w0, bench)
                found.append((window, place + w0, size))
            yield batch.slice(lo, hi - lo), bounds, words, row_of, tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(batches, bench):
    bench = bench.value
    for rows, bounds, words, row_of, (window, place, size) in _searched(batches, bench, 2):
        n = rows.num_rows
        columns = [rows.column(0), rows.column(1), pa.array(np.diff(bounds))]
        if not len(place):
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([[]] * n, pa.list_(pa.int64()))] * 6], _NAMES)
            continue
        starts, ends = _runs(_covered(place, size, len(words)), row_of)
        lists = np.unique(row_of[place] * len(bench.list_bounds) + bench.list_of[window])
        which, texts = ragged(bench.texts_of, bench.list_bounds, lists % len(bench.list_bounds))
        pairs = np.unique(lists[which] // len(bench.list_bounds) * len(bench.bounds) + texts)
        which, item = ragged(np.arange(len(bench.ids)), bench.id_bounds, pairs % len(bench.bounds))
        item_row = (pairs // len(bench.bounds))[which]
        at, text, length = _matches(words, row_of, (window, place, size), bench)
        as_lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)  # noqa: B023, E731
        ids = lambda items: pa.array([bench.ids[i] for i in items.tolist()], pa.int64())
        first = bounds[row_of[starts]]
        yield pa.RecordBatch.from_arrays(
            [*columns, as_lists(row_of[starts], pa.array(starts - first)), as_lists(row_of[starts], pa.array(ends - first)), as_lists(item_row, ids(item)),
             as_lists(row_of[at], ids(bench.id_bounds[text])), as_lists(row_of[at], pa.array(at - bounds[row_of[at]])), as_lists(row_of[at], pa.array(length))], _NAMES)


def _clean(batches, bench, column: int):
    for rows, _, _, row_of, (_, place, _) in _searched(batches, bench.value, column):
        keep = np.ones(rows.num_rows, bool)
        keep[row_of[place]] = False
        yield rows.filter(pa.array(keep))


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _blocks(items: DataFrame, limit: int):
    """Lists of (id, text) of at most limit bytes of text each, read one after the other from the driver's iterator."""
    block, used = [], 0
    for row in items.toLocalIterator():
        size = len(row[1] or "")
        if block and used + size > limit:
            yield block
            block, used = [], 0
        block.append((row[0], row[1]))
        used += size
    yield block


def contamination(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, items (ids with an occurring window), matches.

    matches lists the longest verbatim matches: item, first word, words. One of at least a window's
    words is listed if it isn't the rest of the match that begins a word before.
    """
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = _blocks(items.select(F.col(f"`{item_id}`").cast("bigint"), F.col(f"`{item_text}`")), BLOCK_TEXT_BYTES)
    block, another = next(blocks), next(blocks, None)
    out = None
    if another is not None:  # row numbers that all scans share; a block's result is written, and its broadcast released
        texts = stored(texts, "numbered-texts")
    while block is not None:
        bench = spark.sparkContext.broadcast(Benchmark([b[0] for b in block], [b[1] for b in block], window))
        scan = map_arrow(texts, lambda it, b=bench: _scan(it, b), SCHEMA)
        if out is not None or another is not None:
            scan = stored(scan, "hits")
            bench.destroy()
        out = scan if out is None else out.unionByName(scan)
        several, block = out is not scan, another
        another = next(blocks, None) if block is not None else None
    if several:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in _NAMES[3:]]
        out = out.groupBy("rid", "doc_id", "n_words").agg(*lists)
    spans = F.array_sort(F.arrays_zip("hit_start", "hit_end"))
    step = lambda a, x: F.struct(
        F.greatest(a["upto"], x["hit_end"]).alias("upto"), (a["n"] + F.greatest(x["hit_end"] - F.greatest(a["upto"], x["hit_start"]), F.lit(0))).alias("n")
    )
    n_hit = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n")), step, lambda a: a["n"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.array_distinct("items").alias("items"),
        F.arrays_zip(F.col("match_item").alias("item"), F.col("match_at").alias("at"), F.col("match_words").alias("words")).alias("matches"),
    )


def without_hits(docs: DataFrame, text_col: str, items: DataFrame, item_text: str, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the items occurs; nothing is joined or shuffled."""
    spark, column, left = docs.sparkSession, docs.columns.index(text_col), None
    for block in _blocks(items.select(F.lit(None).cast("bigint"), F.col(f"`{item_text}`")), BLOCK_TEXT_BYTES):
        bench = spark.sparkContext.broadcast(Benchmark([b[0] for b in block], [b[1] for b in block], window))
        docs = docs if left is None else stored(left, "clean")
        left = map_arrow(docs, lambda it, b=bench: _clean(it, b, column), docs.schema)
    return left


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("")))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
