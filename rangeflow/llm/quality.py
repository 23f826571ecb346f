"""Quality rules: base counts, and the divergence of a document from language references.

A language's reference is two histograms over all its documents: character classes, and its common
words, those that make at least one in COMMON of its words, with one bin for all others. A document is
compared with the references by the Jensen-Shannon distance (base 2, so from 0 to 1) of both
histograms; the nearest language is the one with the least sum. A document fails the rule if a distance
is above its limit there and the document is long enough for that histogram to say anything.

Counts are integers over the whole corpus, so references don't depend on the order of rows; common
words are chosen by share, of which a language has at most COMMON.

Defined cases: a null text has no words, lines or characters and fails the base rule by its length;
documents without a language are judged but are in no reference; without references only the base
rule decides; repeated and null ids change nothing; equal texts get equal values; an empty table gives
an empty table; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, NON_SPACE, map_arrow, mix64, read_table, stored, text_blocks, word_hashes

#: Fixed values of the base rule: words of a window, least words, most repeated words in a hundred.
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
SYMBOLS = "#*$%&|<>"
#: A common word makes at least one in so many of its language's words.
COMMON = 200
#: Character classes; what is in none of them, and not ASCII, is the last class.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:!?'\"()-", SYMBOLS]
#: A histogram is judged from so many characters, or words of letters, on.
LEAST_CHARACTERS, LEAST_LETTER_WORDS = 200, 100
#: Documents farther from their nearest reference fail.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.31, 0.3
#: References of more languages are refused rather than cut.
MOST_LANGUAGES = 512

_OTHER, _NON_ASCII, _INSIDE = len(CLASSES), len(CLASSES) + 1, len(CLASSES) + 2
N_CLASSES = len(CLASSES) + 2

_CLASS_OF = np.full(256, _OTHER, np.uint8)
for _k, _characters in enumerate(CLASSES):
    _CLASS_OF[list(_characters.encode())] = _k
_CLASS_OF[0xC0:] = _NON_ASCII
_CLASS_OF[0x80:0xC0] = _INSIDE  # a code point counts by its first byte
_WORD_BYTE = np.where(NON_SPACE > 0, np.arange(256), 0).astype(np.uint8)
_WORD_BYTE[0] = 0xFF
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_FIRST_WORD_BYTE = (_WORD_BYTE > 0) & (_CLASS_OF != _INSIDE)


def _sums(marked: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row, the words in windows that its words have twice or more."""
    n = max(0, len(hashes) - WINDOW + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows = mix64(windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places = np.flatnonzero(row[:n] == row[len(row) - n :])
    order = places[np.lexsort((windows[places], row[places]))]
    same = (windows[order][1:] == windows[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        covered[order[twice] + k] = True
    return _sums(covered, first)


def duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def class_counts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """rows x classes"""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    counts = np.bincount(row * (N_CLASSES + 1) + _CLASS_OF[raw], minlength=(len(offs) - 1) * (N_CLASSES + 1))
    return counts.reshape(-1, N_CLASSES + 1)[:, :N_CLASSES]


# -- references ------------------------------------------------------------------------------------


def _count(batches):
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(1)):
            langs, codes = np.unique(batch.column(0).slice(lo, hi - lo).to_pylist(), return_inverse=True)
            classes = np.zeros((len(langs), N_CLASSES), np.int64)
            np.add.at(classes, codes, class_counts(raw, offs))
            hashes, first = word_hashes(raw, offs, LETTERS)
            different, place = np.unique(hashes, return_inverse=True)
            keys, counts = np.unique(np.repeat(codes, np.diff(first)) * max(1, len(different)) + place, return_counts=True)
            lang = np.concatenate([np.repeat(np.arange(len(langs)), N_CLASSES), keys // max(1, len(different))])
            word = np.concatenate([np.tile(np.arange(N_CLASSES), len(langs)), different[keys % max(1, len(different))].view(np.int64)])
            kind = np.repeat([False, True], [classes.size, len(keys)])
            yield pa.RecordBatch.from_arrays([pa.array(langs[lang].tolist(), pa.string()), pa.array(kind), pa.array(word.astype(np.int64)), pa.array(np.concatenate([classes.ravel(), counts]))], ["lang", "is_word", "key", "n"])


class Reference:
    """A language's class shares, its common words' hashes in order and their shares, that of all others last."""

    def __init__(self, classes: dict[int, int], words: dict[int, int], all_words: int):
        counts = np.array([classes.get(k, 0) for k in range(N_CLASSES)], np.float64)
        self.classes = counts / max(1.0, counts.sum())
        hashes = np.array(list(words), np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, n = hashes[order], np.array(list(words.values()), np.float64)[order]
        self.words = np.append(n, all_words - n.sum()) / max(1, all_words)

    def word_counts(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """rows x bins of common words and others"""
        bins = len(self.words)
        place = np.full(len(hashes), bins - 1)
        if bins > 1:
            at = np.minimum(np.searchsorted(self.hashes, hashes), bins - 2)
            place = np.where(self.hashes[at] == hashes, at, bins - 1)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return np.bincount(row * bins + place, minlength=(len(first) - 1) * bins).reshape(-1, bins)


def references(docs: DataFrame, text_col: str, lang_col: str) -> list[Reference]:
    """A reference for each language, in the order of their names, counted over all rows of docs."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang is not null and text is not null")
    counts = map_arrow(rows, _count, "lang string, is_word boolean, key bigint, n bigint").groupBy("lang", "is_word", "key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "word-counts")
    totals = counts.groupBy("lang", "is_word").agg(F.sum("n").alias("total"))
    found = counts.join(totals, ["lang", "is_word"]).filter(~F.col("is_word") | (F.col("n") * COMMON >= F.col("total")))
    # at most COMMON words and the classes of each language
    found = found.limit(MOST_LANGUAGES * (COMMON + N_CLASSES) + 1).collect()
    langs = sorted({r["lang"] for r in found})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values: judge groups of languages apart")
    parts = {lang: ({}, {}, [0]) for lang in langs}
    for r in found:
        parts[r["lang"]][int(r["is_word"])][r["key"]] = r["n"]
        if r["is_word"]:
            parts[r["lang"]][2][0] = r["total"]
    return [Reference(classes, words, total[0]) for classes, words, total in parts.values()]


# -- judgement -------------------------------------------------------------------------------------


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, base 2, of the histogram p from each row of q."""
    middle = (p + q) / 2
    left = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(middle > 0, middle, 1)), 0)
    right = np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / np.where(middle > 0, middle, 1)), 0)
    return np.sqrt(np.maximum((left + right).sum(axis=1) / 2, 0))


def _judge(batches, shared):
    for batch in batches:
        for lo, hi, raw, offs in text_blocks(batch.column(1)):
            hashes, first = word_hashes(raw, offs, _WORD_BYTE)
            n_words, repeats = np.diff(first), repeated_words(hashes, first)
            lines = np.array([duplicate_lines(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()], np.int64)
            base_failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
            classes = class_counts(raw, offs)
            n_characters = classes.sum(axis=1)
            hashes, first = word_hashes(raw, offs, LETTERS)
            n_letter_words = np.diff(first)
            best = np.full(hi - lo, np.inf)
            near = np.full((hi - lo, 2), np.nan)
            for reference in shared.value:
                by_class = js_distance(reference.classes, classes / np.maximum(n_characters, 1)[:, None])
                by_word = js_distance(reference.words, reference.word_counts(hashes, first) / np.maximum(n_letter_words, 1)[:, None])
                nearer = by_class + by_word < best
                best[nearer] = (by_class + by_word)[nearer]
                near[nearer, 0], near[nearer, 1] = by_class[nearer], by_word[nearer]
            near[n_characters < LEAST_CHARACTERS, 0] = np.nan
            near[n_letter_words < LEAST_LETTER_WORDS, 1] = np.nan
            far = (near > [MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE]).any(axis=1)
            numbers = [n_words, _sums(_FIRST_WORD_BYTE[raw], offs), _sums(_IS_SYMBOL[raw], offs), lines, repeats]
            columns = [pa.array(c.astype(np.int64)) for c in numbers] + [pa.array(base_failed), pa.array(~(base_failed | far))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns, *(pa.array(c, mask=np.isnan(c)) for c in near.T)], NAMES)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, id_col: str, text_col: str, known: list[Reference]) -> DataFrame:
    """A row of counts, distances and the verdict for every row; a distance is null where it isn't judged.

    The references' broadcast has at most MOST_LANGUAGES * COMMON words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, lambda it: _judge(it, shared), RESULT)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = judge(docs, "doc_id", "text", references(docs, "text", "lang"))
    return found.withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


def _only(characters: str) -> str:
    """SQL for the number of t's characters that are among these."""
    listed = "".join(f"\\x{ord(c):02X}" for c in characters)
    return f"length(regexp_replace(t, '[^{listed}]', '', 'g'))"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A bin's share of the divergence, for shares p and q.
_TERM = "case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end"

OP13_SQL = f"""
with docs as materialized (
    select row_number() over () as rid, doc_id, lang, text is not null as has_text, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x60\\x7B-\\x7F]+') as letters,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
    from documents),
windows as (
    select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n
    from (select rid, w, unnest(range(1, len(w) - 1)) as i from docs)),
repeats as (select rid, count(distinct i + k) as n from windows, range(0, {WINDOW}) as r(k) where n >= 2 group by rid),
base as materialized (
    select rid, doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, {_only(SYMBOLS)} as n_symbols,
           len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(w) < {LEAST_WORDS} or 100 * coalesce(n, 0) > {MOST_REPEATED} * len(w) as base_failed,
           length(t) as n_characters, len(letters) as n_letter_words
    from docs left join repeats using (rid)),
classed as materialized (
    select rid, lang, has_text, unnest(c || [length(t) - list_sum(c) - non_ascii, non_ascii]) as n, unnest(range(0, {N_CLASSES})) as k
    from (select rid, lang, has_text, t, [{", ".join(_only(c) for c in CLASSES)}] as c, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) as non_ascii from docs)),
class_reference as materialized (
    select lang, k, n / greatest(1, sum(n) over (partition by lang)) as p
    from (select lang, k, sum(n)::double as n from classed where lang is not null and has_text group by all)),
spoken as materialized (select rid, word, count(*) as n from (select rid, unnest(letters) as word from docs) group by all),
word_counts as (
    select lang, word, n, sum(n) over (partition by lang) as total
    from (select lang, word, sum(n) as n from spoken join docs using (rid) where lang is not null group by all)),
common as materialized (select lang, word, n::double / total::double as p from word_counts where n * {COMMON} >= total),
others as (select l.lang, case when bool_or(s.lang is not null) then 1 else 0 end - coalesce(max(c.p), 0) as p
    from (select distinct lang from class_reference) l left join (select lang, sum(p) as p from common group by lang) c on l.lang = c.lang left join (select distinct lang from word_counts) s on l.lang = s.lang group by l.lang),
bins as materialized (
    select b.rid, c.lang, c.word, c.p, coalesce(s.n, 0) / greatest(1, n_letter_words) as q from base b cross join common c left join spoken s on s.rid = b.rid and s.word = c.word),
all_bins as (
    select lang, rid, p, q from bins
    union all
    select o.lang, b.rid, o.p, case when n_letter_words > 0 then 1 else 0 end - coalesce(x.q, 0)
    from others o cross join base b left join (select rid, lang, sum(q) as q from bins group by all) x on x.rid = b.rid and x.lang = o.lang),
word_distances as (select rid, lang, sqrt(greatest(0, sum({_TERM}) / 2)) as by_word from all_bins group by all),
class_distances as (
    select rid, lang, sqrt(greatest(0, sum({_TERM}) / 2)) as by_class
    from (select c.rid, r.lang, r.p, c.n / greatest(1, n_characters) as q from classed c join base using (rid) join class_reference r using (k)) group by all),
nearest as (
    select rid, by_class, by_word from class_distances join word_distances using (rid, lang)
    qualify row_number() over (partition by rid order by by_class + by_word, lang) = 1),
judged as (
    select base.*, case when n_characters >= {LEAST_CHARACTERS} then by_class end as by_class, case when n_letter_words >= {LEAST_LETTER_WORDS} then by_word end as by_word
    from base left join nearest using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(by_class, 0) <= {MOST_CLASS_DISTANCE} and coalesce(by_word, 0) <= {MOST_WORD_DISTANCE} as kept,
       round(by_class, 4) as class_distance, round(by_word, 4) as word_distance
from judged
"""
