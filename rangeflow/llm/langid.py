"""Language identification as inference of a multilingual mixture.

A model holds, for each language, the log likelihoods of hashed byte trigrams within words. A word's
likelihood under a language is the product over its trigrams. Expectation-maximisation estimates a
document's language proportions from its words' likelihoods. The language set is selected by
penalised likelihood: starting from all languages, the weakest is removed as long as twice the loss
in log likelihood stays below log(words) for the parameter saved.

Defined cases: a null text, or one without a letter, is "und" with score 0; equal rows get equal
values; without learnable rows everything is "und"; an empty table gives an empty table; only the
named columns are read. Letters are those of Unicode; bytes of other non-ASCII characters count as
parts of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, crc_remainder, map_arrow, read_table, text_blocks, unit_hash, word_bounds

BITS = 16
#: Documents of each language that the model is fitted on, at most about so many (a bounded sample).
TRAIN_DOCUMENTS = 3000
SMOOTHING = 0.5
FIRST_STEPS, MORE_STEPS = 10, 5
#: A model of more languages (256 KiB each) is refused rather than cut: it would not fit beside a worker's batches.
MOST_LANGUAGES = 128


def trigrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, start of each word in them, first word of each row)."""
    low = LETTERS[raw]
    starts, ends = word_bounds(low, offs)
    wide = low.astype(np.uint32)
    before, after = np.zeros_like(wide), np.zeros_like(wide)
    before[1:], after[:-1] = wide[:-1], wide[1:]
    before[starts] = 0
    after[ends - 1] = 0
    at = np.flatnonzero(low)
    code = (before[at] * np.uint32(0x9E3779B1)) ^ (wide[at] * np.uint32(0x85EBCA77)) + (after[at] * np.uint32(0xC2B2AE3D))
    code ^= code >> np.uint32(15)
    bucket = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    sizes = ends - starts
    return bucket.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes, np.searchsorted(starts, offs)


def _count(batches):
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(1)):
            if not len(raw):
                continue
            buckets, word_at, first = trigrams(raw, offs)
            at = np.append(word_at, len(buckets))[first]
            langs, codes = np.unique(batch.column(0).slice(lo, hi - lo).to_pylist(), return_inverse=True)
            keys, counts = np.unique(np.repeat(codes, np.diff(at)) << BITS | buckets, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs[keys >> BITS].tolist(), pa.string()), pa.array(keys & ((1 << BITS) - 1)), pa.array(counts)], ["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods of shape buckets x languages) from the rows of docs with a language.

    At most about `most` different documents a language, drawn by a hash of their id and text, are
    read; rows with the same id and text count once. The counts are one array of fixed length for each
    language. All languages are learned; over MOST_LANGUAGES of them are a ValueError.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("lang is not null and text is not null")
    rows = rows.withColumn("at", unit_hash(F.col("doc_id"), F.xxhash64("text"), seed="langid"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values: learn groups of languages apart")
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / max(1, n)))])
    sample = rows.filter(F.col("at") < share[F.col("lang")]).dropDuplicates(["lang", "at"])
    counts = map_arrow(sample.select("lang", "text"), _count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(sizes)
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])[F.col("lang")]
    cells = counts.select(number.cast("short").alias("lang"), F.col("bucket").cast("int").alias("bucket"), "n").toArrow()  # at most buckets x languages
    known, of = np.unique(cells["lang"].to_numpy(), return_inverse=True)
    langs = [names[k] for k in known]
    table = np.zeros((1 << BITS, len(langs)))
    table[cells["bucket"].to_numpy(), of] = cells["n"].to_numpy()
    seen = max(1, int((table.sum(axis=1) > 0).sum()))
    return langs, np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * seen)).astype(np.float32)


def mixtures(likelihood: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Language proportions of each document (rows x languages) from word log likelihoods; 0 rows without words."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), likelihood.shape[1]), np.float32)
    docs = np.flatnonzero(sizes)
    if not len(docs):
        return out
    top = likelihood.max(axis=1, keepdims=True)
    chance = np.exp(likelihood - top)
    cuts, n = bounds[:-1][docs], sizes[docs].astype(np.float32)
    doc_of = np.repeat(np.arange(len(docs)), sizes[docs])

    def em(part: np.ndarray, steps: int, words: np.ndarray, of: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            joint = words * part[of]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
            part = np.add.reduceat(joint, at, axis=0) / size[:, None]
        fit = np.log(np.maximum((words * part[of]).sum(axis=1), 1e-30))
        return part, np.add.reduceat(fit.astype(np.float64), at)

    part, score = em(np.full((len(docs), likelihood.shape[1]), 1 / likelihood.shape[1], np.float32), FIRST_STEPS, chance, doc_of, cuts, n)
    live = np.arange(len(docs))
    words, of, at = chance, doc_of, cuts
    while True:
        kept = part[live] > 0
        going = kept.sum(axis=1) > 1
        if not going.all():
            stay = going[of]
            words, live = words[stay], live[going]
            of = (np.cumsum(going) - 1)[of[stay]]
        if not len(live):
            break
        at = np.searchsorted(of, np.arange(len(live)))
        now = part[live]
        weakest = np.where(now > 0, now, 2).argmin(axis=1)
        trial = now.copy()
        trial[np.arange(len(live)), weakest] = 0
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-30)
        trial, fit = em(trial, MORE_STEPS, words, of, at, n[live])
        better = 2 * (score[live] - fit) < np.log(np.maximum(n[live], 2))
        part[live[better]], score[live[better]] = trial[better], fit[better]
        # a rejected removal ends that document's search
        stay = better[of]
        words = words[stay]
        of = (np.cumsum(better) - 1)[of[stay]]
        live = live[better]
        if not len(live):
            break
    out[docs] = part
    return out


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predict(batches, model):
    langs, table = model.value
    # a block's likelihoods have a column for each language
    limit = max(1 << 14, (4 << 20) // max(8, 2 * len(langs)))
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(1), limit):
            ids = batch.column(0).slice(lo, hi - lo)
            texts = batch.column(1).slice(lo, hi - lo)
            parts = np.zeros((hi - lo, max(1, len(langs))), np.float32)
            if len(langs) and len(raw):
                buckets, word_at, first = trigrams(raw, offs)
                if len(word_at):
                    parts = mixtures(np.add.reduceat(table[buckets], word_at, axis=0), first)
            best, score = parts.argmax(axis=1), parts.max(axis=1)
            names = [langs[b] if langs and _has_letter(t.as_py()) else "und" for b, t in zip(best.tolist(), texts, strict=True)]
            scores = [min(1.0, float(s)) if n != "und" else 0.0 for s, n in zip(score, names, strict=True)]
            lists = pa.array([[{"lang": langs[k], "share": float(p[k])} for k in np.flatnonzero(p)] if n != "und" else [] for p, n in zip(parts, names, strict=True)], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64()), lists], ["doc_id", "lang_pred", "score", "mixture"])


def predict(docs: DataFrame, id_col: str, text_col: str, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, mixture): the largest proportion, its language and all proportions.

    The model is broadcast: 4 bytes x 2**BITS x languages, which fit() bounds.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, table))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, lambda it: _predict(it, model), "doc_id bigint, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    langs, table = fit(docs.filter(~held_out), "doc_id", "text", "lang")
    share = lambda x: F.concat_ws(":", x["lang"], F.round(x["share"], 4).cast("string"))
    mixture = F.array_join(F.transform("mixture", share), ",").alias("mixture")
    return predict(docs, "doc_id", "text", langs, table).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", mixture)
