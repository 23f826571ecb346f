"""Toxicity scores from a factorization machine over hashed terms.

A text is its set of hashed words. The score is logistic(bias + sum of the words' weights + sum over
pairs of the product of their factor vectors), so that pairs such as an insult and the mention of a
group count beyond their parts; the pair sum takes linear time by the usual square identity. The
machine is fitted by AdaGrad on a bounded sample of labelled rows.

Defined cases: null and empty texts score by the bias alone; without training rows of both labels
every score is the share of label 1, or 0; rows with a null label are not learned from; a document
with both labels is learned from with each; equal rows get equal scores; an empty table gives an
empty table; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, crc_remainder, map_arrow, read_table, release_memory, segment_sums, stored, text_blocks, unit_hash, word_hashes

BITS, FACTORS = 18, 4
#: The machine is fitted on about so many labelled rows with about so many terms at most (a bounded sample).
TRAIN_ROWS, TRAIN_TERMS = 12_000, 8_000_000
#: A term is learned if so many of the sampled rows have it and the log-likelihood ratio of its
#: association with the label is so large, by itself or together with another term; other words would
#: only let the machine remember rows.
LEAST_ROWS, LEAST_RATIO = 5, 15.0
#: Pairs are counted in tables of about so many cells and listed in runs of about as many, on the
#: sampled rows with the fewest terms that together have at most PAIRS pairs (a bounded sample).
PAIR_CELLS, PAIRS = 1 << 20, 500_000_000
EPOCHS, RATE, RATE_FACTOR, DECAY_WEIGHT, DECAY_FACTOR = 200, 0.3, 0.08, 5e-5, 3e-4


@dataclass
class Machine:
    """weights and factors are 0 for terms that weren't learned."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        weights, factors = self.weights[terms], self.factors[terms]
        linear = segment_sums(weights.astype(np.float64), bounds)
        sums, squares = segment_sums(factors.astype(np.float64), bounds), segment_sums((factors * factors).astype(np.float64), bounds)
        raw = self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def terms_of(raw: np.ndarray, offs: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, bounds): the distinct terms of each row in order; useful keeps those it marks."""
    hashes, first = word_hashes(raw, offs, LETTERS)
    buckets = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    if useful is not None:
        keep = useful[buckets]
        buckets, rows = buckets[keep], rows[keep]
    keys = np.unique(rows << BITS | buckets)
    return keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(len(offs)))


def _features(batches):
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(0)):
            terms, bounds = terms_of(raw, offs)
            data = [terms[bounds[i] : bounds[i + 1]].astype("<i4").tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(data, pa.binary())], ["label", "terms"])


def associated(with_1: np.ndarray, with_any: np.ndarray, ones: float, n: float) -> np.ndarray:
    """The log-likelihood ratio statistic of each term's 2 x 2 table with the label."""
    cells = [(with_1, with_any * ones / n), (with_any - with_1, with_any * (n - ones) / n), (ones - with_1, (n - with_any) * ones / n), (n - ones - with_any + with_1, (n - with_any) * (n - ones) / n)]
    return 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in cells)


def paired(lists: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The terms of the pairs that are associated with the label beyond both parts.

    Among the rows of each of the two terms the other must be associated with the label. The ratio
    asked for grows with the number of pairs for each term, so that chance lets no more pairs pass than
    terms. Terms whose rows' labels have too little entropy for any ratio that high are left out first.
    Rows beyond the shortest with PAIRS pairs in all are not counted.
    """
    common = np.flatnonzero(seen >= LEAST_ROWS)
    share = toxic[common] / seen[common]
    highest = -2 * seen[common] * (share * np.log(np.maximum(share, 1e-9)) + (1 - share) * np.log(np.maximum(1 - share, 1e-9)))
    least = LEAST_RATIO
    candidates = common[highest >= least]
    least += 2 * np.log(max(1.0, len(candidates) * (len(candidates) - 1) / 2 / max(1, len(common))))
    candidates = common[highest >= least]
    size = len(candidates)
    place = np.full(len(seen), -1, np.int64)
    place[candidates] = np.arange(size)
    at = place[np.concatenate(lists)].astype(np.int32)
    row_of = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])[at >= 0]
    at = at[at >= 0]
    pairs = np.bincount(row_of, minlength=len(lists)).astype(np.int64)
    pairs = pairs * (pairs - 1) // 2
    shortest = np.argsort(pairs, kind="stable")
    counted = np.zeros(len(lists), bool)
    counted[shortest[np.cumsum(pairs[shortest]) <= PAIRS]] = True
    at, row_of = at[counted[row_of]], row_of[counted[row_of]]
    ends = np.searchsorted(row_of, np.arange(len(lists)), "right")
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(size + 1))
    n = np.bincount(at, minlength=size).astype(np.float64)
    ones = np.bincount(at, labels[row_of] == 1, minlength=size)
    chosen = np.zeros(size, bool)
    step = max(1, PAIR_CELLS // max(1, size))
    for lo in range(0, size, step):
        hi = min(lo + step, size)
        entries = order[cuts[lo] : cuts[hi]]
        later = ends[row_of[entries]] - entries - 1  # a row's terms are in order: each is paired with those behind it
        both, both_1 = np.zeros((hi - lo) * size, np.int32), np.zeros((hi - lo) * size, np.int32)
        runs = np.cumsum(later) // PAIR_CELLS
        for run in np.split(np.arange(len(entries)), np.flatnonzero(np.diff(runs)) + 1):
            some, n_later = entries[run], later[run]
            partner = at[np.repeat(some + 1 - (np.cumsum(n_later) - n_later), n_later) + np.arange(n_later.sum())]
            keys = np.repeat((at[some].astype(np.int64) - lo) * size, n_later) + partner
            both += np.bincount(keys, minlength=len(both)).astype(np.int32)
            both_1 += np.bincount(keys[np.repeat(labels[row_of[some]] == 1, n_later)], minlength=len(both)).astype(np.int32)
        both, both_1 = both.reshape(hi - lo, size), both_1.reshape(hi - lo, size)
        a, b = np.nonzero(both >= LEAST_ROWS)
        a, b = a[a + lo < b], b[a + lo < b]
        pair, pair_1 = both[a, b].astype(np.float64), both_1[a, b].astype(np.float64)
        a += lo
        high = associated(pair_1, pair, ones[a], n[a]) >= least
        a, b, pair, pair_1 = a[high], b[high], pair[high], pair_1[high]
        high = associated(pair_1, pair, ones[b], n[b]) >= least
        a, b = a[high], b[high]
        chosen[a] = chosen[b] = True
    return candidates[chosen]


def fit_machine(lists: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fits by AdaGrad over all rows at once; reruns give the same machine."""
    size, positive = 1 << BITS, float(labels.mean()) if len(labels) else 0.0
    blank = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if positive in (0.0, 1.0):
        blank.bias = 40.0 if positive else -40.0
        return blank
    seen, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for terms, label in zip(lists, labels, strict=True):  # a row's terms differ
        seen[terms] += 1
        toxic[terms] += int(label)
    alone = np.flatnonzero((seen >= LEAST_ROWS) & (associated(toxic, seen, float(labels.sum()), float(len(labels))) >= LEAST_RATIO))
    vocabulary = np.union1d(alone, paired(lists, labels, seen, toxic))
    place = np.full(size, -1, np.int64)
    place[vocabulary] = np.arange(len(vocabulary))
    known = [place[x][place[x] >= 0] for x in lists]
    flat, rows = np.concatenate(known), np.repeat(np.arange(len(lists)), [len(x) for x in known])
    bounds = np.searchsorted(rows, np.arange(len(lists) + 1))
    n = len(vocabulary)
    weights, factors = np.zeros(n), np.random.default_rng(5).normal(0, 0.01, (n, FACTORS))
    bias, g_bias, g_w, g_v = float(np.log(positive / (1 - positive))), 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        v = factors[flat]
        sums = segment_sums(v, bounds)
        raw = bias + segment_sums(weights[flat], bounds) + 0.5 * ((sums * sums).sum(axis=1) - segment_sums((v * v).sum(axis=1), bounds))
        slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / len(labels)
        d_w = np.bincount(flat, slope[rows], n) + DECAY_WEIGHT * weights
        d_v = np.stack([np.bincount(flat, slope[rows] * (sums[rows, k] - v[:, k]), n) for k in range(FACTORS)], axis=1) + DECAY_FACTOR * factors
        d_b = float(slope.sum())
        g_w += d_w**2
        g_v += d_v**2
        g_bias += d_b**2
        weights -= RATE * d_w / np.sqrt(g_w)
        factors -= RATE_FACTOR * d_v / np.sqrt(g_v)
        bias -= RATE * d_b / g_bias**0.5
    blank.bias = bias
    blank.weights[vocabulary], blank.factors[vocabulary] = weights, factors
    return blank


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, most: int = TRAIN_ROWS) -> Machine:
    """Learns label_col of labels (by id_col) from the texts of docs; learn says which doc_id may be used.

    About `most` rows and TRAIN_TERMS terms, drawn by hashes, reach the driver as hashed terms. Of
    rows with the same label and terms that share of their number is drawn, so the sample doesn't
    depend on partitions.
    """
    marked = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(learn & F.col("label").isin(0, 1)).distinct()
    share = min(1.0, most / max(1, marked.count()))
    marked = marked.filter(unit_hash(F.col("doc_id"), seed="toxicity") < share)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = map_arrow(texts.join(marked, "doc_id").select("text", "label"), _features, "label int, terms binary")
    rows = stored(rows.groupBy("label", "terms").agg(F.count("*").alias("n")), "toxicity-rows")
    n, terms = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.octet_length("terms")), F.lit(0)) / 4).first()
    share = min(1.0, most / max(1, n), TRAIN_TERMS / max(1, terms))  # ids can repeat, and texts can be long
    drawn = F.floor(F.col("n") * share + unit_hash(F.xxhash64("label", "terms"), seed="toxicity-rows")).cast("int")
    rows = rows.withColumn("n", drawn).filter("n > 0").toArrow().sort_by([("label", "ascending"), ("terms", "ascending")])
    copies = rows["n"].to_numpy()
    lists = [np.frombuffer(x.as_buffer(), "<i4") for x in rows["terms"]]
    machine = fit_machine([x for x, c in zip(lists, copies, strict=True) for _ in range(c)], np.repeat(rows["label"].to_numpy().astype(np.float64), copies))
    del rows
    release_memory()
    return machine


def _scored(batches, shared, column: int):
    """(rows of a block, their scores)"""
    machine = shared.value
    useful = (machine.weights != 0) | machine.factors.any(axis=1)
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(column)):
            yield batch.slice(lo, hi - lo), machine.scores(*terms_of(raw, offs, useful))


def _score(batches, shared):
    for rows, scores in _scored(batches, shared, 1):
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def _below(batches, shared, column: int, threshold: float):
    for rows, scores in _scored(batches, shared, column):
        yield rows.filter(pa.array(scores < threshold))


def score(docs: DataFrame, id_col: str, text_col: str, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row; the machine's broadcast has a fixed size, 2**BITS terms."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, lambda it: _score(it, shared), "doc_id bigint, score double")


def without_toxic(docs: DataFrame, text_col: str, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; nothing is joined or shuffled."""
    shared, column = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)
    return map_arrow(docs, lambda it: _below(it, shared, column, threshold), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    machine = fit(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out)
    return score(docs, "doc_id", "text", machine).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
