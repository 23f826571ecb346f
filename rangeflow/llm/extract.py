"""Main text of web pages with host suffix arrays.

Pages are parsed into blocks in page order. Pages of one host are dealt into shards of bounded size;
in each the word streams of all pages are concatenated, a suffix array finds every substring of at
least REPEAT_WORDS words that occurs on two or more different pages, and what such substrings cover
is boilerplate; the unique runs stay. Shards of one host exchange their windows of REPEAT_WORDS
words by hash, so repetition is that of the whole host. Hosts without a page that it decides are not
dealt. Markup decides first where it is explicit: menus, adverts,
scripts and the like are dropped, and an article that holds the bulk of its page, at least as many
words as the unique runs beside it, is the text. On all other pages repetition decides inside and
outside of articles.

Such articles have suffix arrays of their own, since articles of one host may quote each other at
length: only what more than half of a host's different articles have, TEMPLATE_PAGES at least, is
its template and is cut. Articles are dealt by a hash of their text. What stands on more than half of
all does so in one shard at least, so each shard's array names its frequent windows, and the arrays
of all shards count the windows that any has named. Where most of the articles with such windows are
mostly made of them, these are near copies of each other and stay whole.

Defined cases: a null or empty html has the empty text; equal pages count as one page for
repetition, so copies don't erase each other; equal rows each get their text; a null url is the host
""; unclosed tags, comments and attributes end where a browser's would, at the latest with the page;
an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, map_arrow, mix64, read_table, stored, text_blocks, word_hashes
from .decontaminate import SuffixArray

REPEAT_WORDS = 5
SHARD_BYTES = 2 << 20
#: Shards of articles: about so many bytes of text, and so many articles at least.
ARTICLE_BYTES, LEAST_SHARD = 1 << 19, 16
#: A template is on more than half of a host's different articles, and on so many.
TEMPLATE_PAGES = 8
NO_HASHES = np.zeros(0, np.uint64)
TEXT_NAMES, TEXT_TYPES = ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()]
WINDOW_NAMES = ["host", "bucket", "shard", "hashes", "pages", "several"]
WINDOW_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

#: Fixed names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("aside button dialog footer form head menu nav option search select".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ARTICLE_TAGS = frozenset({"article", "main"})
#: Words in class and id attributes of menus, notices, adverts, reader comments and the like.
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice overlay popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)

#: A value in quotes starts right behind its equals sign; any other ends with a space or the tag.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)"""
_ATTRIBUTES = rf"[^>=]*+(?:=\s*+{_VALUE}[^>=]*+)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|iframe|textarea|title|svg|math|object|canvas|noframes|xmp)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(rf"([^\s/>=]+)(?:\s*+=\s*+({_VALUE}))?")
#: Start tags end open elements whose end tags may be left out: which ones, up to which element.
_LISTS, _CELLS, _ROWS = frozenset("ul ol menu dir".split()), frozenset("td th".split()), frozenset("thead tbody tfoot".split())
IMPLIED_ENDS = {
    "li": (frozenset({"li"}), _LISTS),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl"}))),
    **dict.fromkeys(("option", "optgroup"), (frozenset({"option"}), frozenset({"select"}))),
    **dict.fromkeys(_CELLS, (_CELLS, frozenset({"tr", "table"}))),
    "tr": (_CELLS | {"tr", "caption"}, _ROWS | {"table"}),
    **dict.fromkeys(_ROWS, (_ROWS | _CELLS | {"tr", "caption"}, frozenset({"table"}))),
}
#: What ends the search for an open paragraph, and what a head may hold.
P_SCOPE, IN_HEAD = frozenset("table td th caption button".split()), frozenset("html head base link meta title style script noscript template".split())
#: Elements of running text: inside an article their names drop them never.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption em strong b i a code cite q".split())
#: The words of ALPHANUMERIC in a str.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
PLAIN, ARTICLE, DROPPED = 0, 1, 2
DECIDING = frozenset("class id role hidden aria-hidden style".split())
#: A repeated run is cut if it is so long, or whole sentences.
LONG_RUN = 12
SENTENCE_END = re.compile(r"[.!?:;|\u2022\u00b7].*\s|\(", re.S)


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in DECIDING:
            continue
        value = (value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and tag not in ("html", "body", *ARTICLE_TAGS) and not (in_article and tag in TEXT_TAGS):
            for label in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", label) if w]
                # in an article names like reply-to-critics say what the text is about
                if DROPPED_WORDS.intersection(words) and (not in_article or len(words) <= 2):
                    return True
    return False


def parse_blocks(page: str) -> list[tuple[int, str]]:
    """(PLAIN, ARTICLE or DROPPED, text) of the page's non-empty blocks in order."""
    blocks, pieces = [], []
    stack: list[tuple[str, int]] = []  # open elements that matter and the region inside them
    region = PLAIN

    def close() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((region, text))

    def cut(index: int) -> None:
        nonlocal region
        del stack[index:]
        region = stack[-1][1] if stack else PLAIN

    def innermost(names, scope) -> int:
        """The place of the innermost open element of these names, -1 if there is none within the scope."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in scope:
                break
        return -1

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            if stack and stack[-1][0] == "head" and page[at : m.start()].strip():
                cut(len(stack) - 1)
            pieces.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            close()
        if m[2]:
            scope = P_SCOPE if tag == "p" else IMPLIED_ENDS[tag][1] if tag in IMPLIED_ENDS else ()
            i = innermost((tag,), scope)
            if i >= 0:
                if not block:
                    close()
                cut(i)
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close()
            cut(len(stack) - 1)
        if block:
            i = innermost(("p",), P_SCOPE)
            if i >= 0:
                cut(i)
            if tag in IMPLIED_ENDS:
                while (i := innermost(*IMPLIED_ENDS[tag])) >= 0:
                    cut(i)
        if tag in VOID_TAGS:
            continue
        if region != DROPPED and _dropped(tag, m[4], region == ARTICLE):
            if not block:
                close()
            region = DROPPED
            stack.append((tag, region))
        elif region == PLAIN and (tag in ARTICLE_TAGS or 'role="main"' in m[4]):
            region = ARTICLE
            stack.append((tag, region))
        elif block or any(t == tag for t, _ in stack):
            stack.append((tag, region))
    pieces.append(page[at:])
    close()
    return blocks


def word_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of the texts, one after the other, and the index of each text's first word."""
    hashes, bounds = [], [0]
    for _, _, raw, offs in text_blocks(pa.array(texts, pa.string())):
        some, first = word_hashes(raw, offs, ALPHANUMERIC)
        hashes.append(some)
        bounds += list(first[1:] + bounds[-1])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(bounds)


def window_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the REPEAT_WORDS words at the places."""
    hashes = np.zeros(len(places), np.uint64)
    for k in range(REPEAT_WORDS):
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + words[places + k])
    return hashes


def array_groups(words: np.ndarray, page_of: np.ndarray, copy_of: np.ndarray, least: int = REPEAT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the suffix array's order, where its groups begin, how many different pages each group has).

    words are the pages' streams one after the other, page_of their page, copy_of[page] the first
    page with the same stream. Suffixes with the same `least` leading words are neighbours in the
    array and make a group; those that would reach into the next page have none.
    """
    if len(words) < least:
        return (np.zeros(0, np.int64),) * 3
    array = SuffixArray(words, least)
    k = least.bit_length() - 1
    rest = least - (1 << k)
    n = len(words) - least + 1
    key = array.ranks[k][:n] * len(array.tables[k]) + array.ranks[k][rest : rest + n]
    places = np.flatnonzero(page_of[:n] == page_of[least - 1 :])
    order = places[np.lexsort((copy_of[page_of[places]], key[places]))]
    keys, copies = key[order], copy_of[page_of[order]]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(order)]
    page = np.concatenate([[True], copies[1:] != copies[:-1]])[: len(order)] | new
    return order, np.flatnonzero(new), np.bincount(np.cumsum(new)[page] - 1)


def stretches(n: int, places: np.ndarray, length: int) -> np.ndarray:
    """Marks, of n words, the length words from each place on."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, places, 1)
    np.add.at(marks, places + length, -1)
    return np.cumsum(marks[:-1]) > 0


def repeated_words(words: np.ndarray, page_of: np.ndarray, copy_of: np.ndarray, least: int = REPEAT_WORDS, told: np.ndarray = NO_HASHES) -> np.ndarray:
    """Marks the words inside substrings of at least `least` words that stand on two different pages.

    told: sorted hashes of windows (of REPEAT_WORDS words) whose other page is elsewhere; their group of the array counts as repeated.
    """
    order, first, pages = array_groups(words, page_of, copy_of, least)
    several = pages > 1
    if len(told) and len(first):
        hashes = window_hashes(words, order[first])
        several |= told[np.minimum(np.searchsorted(told, hashes), len(told) - 1)] == hashes
    return stretches(len(words), order[np.repeat(several, np.diff(np.append(first, len(order))))], least)


def unique_runs(text: str, covered: np.ndarray) -> str:
    """text without its covered runs that are long or whole sentences; what stands between two words is parted at its last space."""
    if not covered.any():
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    covered = covered.copy()
    ends = [True] + [SENTENCE_END.search(text[a:b]) is not None for (_, a), (b, _) in zip(spans, spans[1:], strict=False)] + [True]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < LONG_RUN:  # only the sentences that it covers whole
            inside = [i for i in range(a, b + 1) if ends[i]] or [a]
            covered[a : inside[0]] = False
            covered[inside[-1] : b] = False
    if not covered.any():
        return text
    cuts = [0]
    for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
        space = text.rfind(" ", end, start)
        cuts.append(start if space < 0 else space + 1)
    cuts.append(len(text))
    turns = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]])))
    runs = [text[cuts[a] : cuts[b]].strip() for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return " ".join(r for r in runs if r)


def page_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Shard:
    """Parsed pages of one host and the stream of their words."""

    def __init__(self, pages: list[str | None]):
        self.parsed = [parse_blocks(p) if p else [] for p in pages]
        self.texts = [text for blocks in self.parsed for _, text in blocks]
        self.regions = np.array([r for blocks in self.parsed for r, _ in blocks], np.int64)
        self.page_of_block = np.repeat(np.arange(len(pages)), [len(b) for b in self.parsed])
        self.words, self.bounds = word_stream(self.texts)
        self.page_of = np.repeat(self.page_of_block, np.diff(self.bounds))
        self.in_article = self._sums(np.diff(self.bounds), ARTICLE)
        #: Pages whose text depends on repetition: fewer words in articles than beside them.
        self.open = self._sums(np.diff(self.bounds), PLAIN) > self.in_article

    def _sums(self, counts: np.ndarray, region: int) -> np.ndarray:
        return np.bincount(self.page_of_block, counts * (self.regions == region), len(self.parsed))

    def copies(self) -> np.ndarray:
        """For each page the first with the same blocks."""
        seen: dict[tuple, int] = {}
        return np.array([seen.setdefault(tuple(blocks), i) for i, blocks in enumerate(self.parsed)], np.int64)

    def distinct_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, hash of a page that has it, whether different pages here have it) for each group of the array."""
        order, first, pages = array_groups(self.words, self.page_of, self.copies())
        page_hashes = np.array([page_hash(repr(b)) for b in self.parsed], np.uint64)
        return window_hashes(self.words, order[first]), page_hashes[self.page_of[order[first]]], pages > 1

    def covered(self, elsewhere: np.ndarray) -> np.ndarray:
        """Marks the words of repeated substrings; elsewhere: sorted hashes of windows that other shards repeat."""
        return repeated_words(self.words, self.page_of, self.copies(), told=elsewhere)

    def main_texts(self, covered: np.ndarray) -> list[str]:
        left = np.diff(np.concatenate([[0], np.cumsum(~covered)])[self.bounds])
        has_article = np.zeros(len(self.parsed), bool)
        has_article[self.page_of_block[self.regions == ARTICLE]] = True
        whole = (has_article & (self.in_article >= self._sums(left, PLAIN)))[self.page_of_block]
        out: list[list[str]] = [[] for _ in self.parsed]
        for i in np.flatnonzero(np.where(whole, self.regions == ARTICLE, self.regions != DROPPED)):
            text = self.texts[i] if whole[i] else unique_runs(self.texts[i], covered[self.bounds[i] : self.bounds[i + 1]])
            if text:
                out[self.page_of_block[i]].append(text)
        return ["\n\n".join(x) for x in out]


def main_texts(pages: list[str | None], elsewhere: np.ndarray = NO_HASHES) -> list[str]:
    """The main text of each page of one host's shard."""
    shard = Shard(pages)
    return shard.main_texts(shard.covered(elsewhere))


def _scan(batches):
    """Texts of the pages that markup decides; null for the others."""
    for batch in batches:
        for lo, hi, _, _ in text_blocks(batch.column("html")):
            part = batch.slice(lo, hi - lo)
            shard = Shard(part.column("html").to_pylist())
            texts = shard.main_texts(np.zeros(len(shard.words), bool))
            texts = pa.array([None if o else t for o, t in zip(shard.open, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "bytes")), texts], ["page_id", "url", "host", "bytes", "text"])


def _windows(table: pa.Table) -> pa.Table:
    """A shard's distinct windows, dealt by hash into as many buckets as its host has shards."""
    host, number, shards = (table.column(c)[0].as_py() for c in ("host", "shard", "shards"))
    rows = []
    if shards > 1:
        hashes, pages, several = Shard(table.column("html").to_pylist()).distinct_windows()
        buckets = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
            if len(part):
                rows.append((host, int(buckets[part[0]]), number, hashes[part].tobytes(), pages[part].tobytes(), several[part].tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, WINDOW_TYPES, strict=True)], WINDOW_NAMES)


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket of a host's windows, for each shard those on one page there and on another page elsewhere."""
    parts = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("hashes", np.uint64), ("pages", np.uint64), ("several", bool))]
    row_of = np.repeat(np.arange(table.num_rows), [len(x) for x in parts[0]])
    hashes, pages, several = (np.concatenate(x) for x in parts)
    order = np.argsort(hashes, kind="stable")
    hashes, pages, several, row_of = hashes[order], pages[order], several[order], row_of[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    differ = np.logical_or.reduceat(several, first) | (np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first))
    told = np.flatnonzero(np.repeat(differ, np.diff(np.concatenate([first, [len(hashes)]]))) & ~several)
    told = told[np.argsort(row_of[told], kind="stable")]
    cuts = np.searchsorted(row_of[told], np.arange(table.num_rows + 1))
    data = [hashes[told[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    out = pa.table([table.column("host"), table.column("shard"), pa.array(data, pa.binary())], ["host", "shard", "hashes"])
    return out.filter(np.diff(cuts) > 0)


def _extract(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
    """The texts of a shard's open pages."""
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in TEXT_TYPES], TEXT_NAMES)
    shard = Shard(table.column("html").to_pylist())
    hashes = np.sort(np.frombuffer(b"".join(elsewhere.column("hashes").to_pylist()), np.uint64))
    texts = shard.main_texts(shard.covered(hashes))
    out = pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], TEXT_NAMES)
    return out.filter(shard.open)


def article_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of the array's groups, how many different texts have each, how many different texts there are)."""
    texts = list(dict.fromkeys(texts))
    words, bounds = word_stream(texts)
    order, first, pages = array_groups(words, np.repeat(np.arange(len(texts)), np.diff(bounds)), np.arange(len(texts)))
    return window_hashes(words, order[first]), pages, len(texts)


def template_cover(blocks: list[str], template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the windows of the template cover each word of the blocks, the index of each block's first word)."""
    words, bounds = word_stream(blocks)
    places = np.arange(max(0, len(words) - REPEAT_WORDS + 1))
    return stretches(len(words), places[np.isin(window_hashes(words, places), template)], REPEAT_WORDS), bounds


def without_template(text: str, template: np.ndarray, near: bool) -> str:
    """text without the runs that the template covers; near: the whole text if that is most of it."""
    blocks = text.split("\n\n")
    covered, bounds = template_cover(blocks, template)
    if near and 2 * covered.sum() > len(covered):
        return text
    left = [unique_runs(x, covered[a:b]) for x, a, b in zip(blocks, bounds, bounds[1:], strict=False)]
    return "\n\n".join(x for x in left if x)


def _articles(batches):
    """Packed articles and their shards, which copies share; a task's copies go once."""
    seen = set()
    for batch in batches:
        rows = []
        for host, shards, text in zip(*(batch.column(c).to_pylist() for c in ("host", "shards", "text")), strict=True):
            number = page_hash(text)
            if (host, number) not in seen:
                seen.add((host, number))
                rows.append((host, shards, number % shards, zlib.compress(text.encode("utf-8", "surrogatepass"))))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "shards", "shard", "packed"])


def _unpacked(table: pa.Table) -> list[str]:
    return [zlib.decompress(x).decode("utf-8", "surrogatepass") for x in table.column("packed").to_pylist()]


def _window_rows(table: pa.Table, hashes: np.ndarray, pages: np.ndarray, different: int) -> pa.Table:
    lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (hashes, pages)]
    return pa.table([table.column("host").slice(0, 1), table.column("shards").slice(0, 1), pa.array([different], pa.int64()), *lists], ["host", "shards", "different", "hashes", "pages"])


def _frequent(table: pa.Table) -> pa.Table:
    """The windows that more than half of a shard's different articles have."""
    hashes, pages, different = article_windows(_unpacked(table))
    frequent = 2 * pages > different
    if table.column("shards")[0].as_py() == 1:
        frequent &= pages >= TEMPLATE_PAGES
    return _window_rows(table, hashes[frequent], pages[frequent], different)


def _counted(table: pa.Table, asked: pa.Table) -> pa.Table:
    """How many different articles of a shard have the windows asked for."""
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2)], ["host", "shards", "different", "hashes", "pages"])
    hashes, pages, different = article_windows(_unpacked(table))
    there = np.isin(hashes.view(np.int64), np.array(asked.column("asked")[0].as_py(), np.int64))
    return _window_rows(table, hashes[there], pages[there], different)


def _template_rows(batch: pa.RecordBatch):
    for text, template in zip(batch.column("text").to_pylist(), batch.column("template").to_pylist(), strict=True):
        yield text, np.array(template, np.int64).view(np.uint64)


def _mostly(batches):
    """Of the articles with template words, whether most of their words are."""
    for batch in batches:
        covers = [template_cover([t], w)[0] for t, w in _template_rows(batch)]
        some = np.array([c.any() for c in covers], bool)
        numbers = np.array([page_hash(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column("host"), pa.array(numbers), pa.array([2 * c.sum() > len(c) for c in covers], pa.bool_())], ["host", "number", "mostly"])
        yield out.filter(pa.array(some))


def _cut(batches):
    for batch in batches:
        texts = [without_template(*row, near) for row, near in zip(_template_rows(batch), batch.column("near").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def article_templates(articles: DataFrame) -> DataFrame:
    """(host, template, near) of the hosts that have a template.

    template: hashes of the windows on more than half of the host's different articles(host, text);
    near: whether most of the articles with such windows are mostly made of them.
    """
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.sum(F.octet_length("text")) / ARTICLE_BYTES), F.floor(F.count("*") / LEAST_SHARD)))
    large = stored(articles.groupBy("host").agg(shards.cast("bigint").alias("shards")).filter("shards > 1"), "large-hosts")

    def dealt(rows: DataFrame):
        rows = rows.join(large, "host", "left").select("host", F.coalesce("shards", F.lit(1)).alias("shards"), "text")
        return map_arrow(rows, _articles, "host string, shards bigint, shard bigint, packed binary").groupBy("host", "shard")

    schema = "host string, shards bigint, different bigint, hashes array<bigint>, pages array<bigint>"
    found = stored(dealt(articles).applyInArrow(_frequent, schema), "frequent-windows")
    asked = found.filter("shards > 1").select("host", F.explode("hashes").alias("hash")).groupBy("host").agg(F.collect_set("hash").alias("asked"))
    asked = stored(asked, "asked-windows")
    counts = found.filter("shards = 1")
    if asked.limit(1).count():
        each = asked.join(large, "host").select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "asked")
        again = dealt(articles.join(asked.select("host"), "host", "left_semi"))
        counts = counts.unionByName(again.cogroup(each.groupBy("host", "shard")).applyInArrow(_counted, schema))
    counts = counts.select("host", F.explode(F.arrays_zip("hashes", "pages")).alias("x")).groupBy("host", F.col("x.hashes").alias("hash")).agg(F.sum("x.pages").alias("n"))
    totals = found.groupBy("host").agg(F.sum("different").alias("different"))
    most = counts.join(totals, "host").filter((F.col("n") >= TEMPLATE_PAGES) & (2 * F.col("n") > F.col("different")))
    templates = stored(most.groupBy("host").agg(F.collect_list("hash").alias("template")), "templates")
    mostly = map_arrow(articles.join(templates, "host").select("host", "text", "template"), _mostly, "host string, number bigint, mostly boolean").distinct()
    near = mostly.groupBy("host").agg((2 * F.count_if("mostly") > F.count("*")).alias("near"))
    return stored(templates.join(near, "host"), "judged-templates")


def extract_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; shards are by host and a hash of page and url."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)))
    sized = rows.withColumn("bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint"))
    scanned = stored(map_arrow(sized, _scan, "page_id bigint, url string, host string, bytes bigint, text string"), "page-texts")
    hosts = scanned.groupBy("host").agg(F.ceil((F.sum("bytes") + 1) / SHARD_BYTES).alias("shards"), F.max(F.col("text").isNull()).alias("open"))
    hosts = stored(hosts.filter("open").select("host", "shards"), "open-hosts")  # its known size spares the pages of other hosts a shuffle
    shard = F.pmod(F.xxhash64("page_id", "url"), F.col("shards"))
    dealt = rows.join(hosts, "host").withColumn("shard", shard).select("host", "shard", "shards", "page_id", "url", "html").groupBy("host", "shard")
    windows = dealt.applyInArrow(_windows, "host string, bucket bigint, shard bigint, hashes binary, pages binary, several binary")
    elsewhere = windows.groupBy("host", "bucket").applyInArrow(_repeated, "host string, shard bigint, hashes binary")
    decided = dealt.cogroup(elsewhere.groupBy("host", "shard")).applyInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
    articles = scanned.filter("text is not null")
    templates = article_templates(articles.filter("text <> ''").select("host", "text"))
    whole = articles.join(templates, "host", "left_anti").select("page_id", "url", "text")
    cut = map_arrow(articles.join(templates, "host").select("page_id", "url", "text", "template", "near"), _cut, "page_id bigint, url string, text string")
    return whole.unionByName(cut).withColumn("n_chars", F.length("text").cast("bigint")).unionByName(decided)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")
