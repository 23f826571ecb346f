"""Near-duplicate detection: one-permutation MinHash with optimal densification and star candidates.

A document is the set of its n-word shingles (64-bit hashes). One hash function throws the set into
K bins, each keeping its smallest value; an empty bin borrows from the first filled bin in an order
drawn for that bin, so that two sets agree in a bin with their Jaccard similarity as probability.
R consecutive bins make a band. Documents with the same set are one class; only class
representatives go on. Within a band's bucket every member is compared with the bucket's centre
(star edges), never all with all, and each candidate is confirmed on the full sets.

A star may miss a link between two members that the centre is not linked with. Buckets of three or
more whose members are not all in one component after the stars stay open, and their members are
joined exactly: a set's shingles are put in one order, rarest first, and two sets of the similarity
asked for must share a shingle among the first few of both (prefix filter), at places that leave
room for the overlap. Only pairs of different components are made: for each shingle, the members
outside its most frequent component against all. No bucket or candidate is capped or left out: of
the links between documents that share a band, none is lost. Two documents of similarity 0.8 share
none of the 32 bands about three times in a million.

Links are between rows: repeated and null ids don't join or part what their texts say.

Defined cases: a null text, or one without words, has the empty set and links with nothing; fewer
than n words are one shingle; equal texts are one class; a null id is never the smallest while its
component has another; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, Scratch, map_arrow, mix64, read_table, stored, text_blocks, word_hashes

BINS, ROWS = 160, 5
BANDS = BINS // ROWS
#: Counters of the shingle frequencies that order the prefixes: a table of fixed size, whatever the input.
COUNTERS = 1 << 20
_rng = np.random.default_rng(77)
#: for each bin the order in which it looks for a filled one: itself, then the others at random
_ORDERS = np.stack([np.concatenate([[b], _rng.permutation([x for x in range(BINS) if x != b])]) for b in range(BINS)])
_BAND_CODES = _rng.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n consecutive words; of all words if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix64(out * _STEP + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(out)


def bands(values: np.ndarray) -> np.ndarray:
    """The band hashes of a non-empty set of hashes."""
    keys = mix64(values ^ np.uint64(0x5851F42D4C957F2D))
    bins = (keys >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
    order = np.lexsort((keys, bins)) if len(keys) < 64 else np.argsort((bins << np.uint64(56)) | (keys >> np.uint64(8)), kind="stable")
    first = np.searchsorted(bins[order], np.arange(BINS, dtype=np.uint64))
    filled = np.zeros(BINS, bool)
    filled[bins.astype(np.int64)] = True
    least = keys[order[np.minimum(first, len(order) - 1)]]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        orders = _ORDERS[empty]
        least[empty] = least[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    mixed = (least.reshape(BANDS, ROWS) * _BAND_CODES).sum(axis=1, dtype=np.uint64)
    return mix64(mixed + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _sets(batch: pa.RecordBatch, n: int):
    """(rows of a block, their sets, their classes): a class is named by a digest of the set, null if that is empty."""
    for lo, hi, raw, offs in text_blocks(batch.column("text")):
        hashes, first = word_hashes(raw, offs, NON_SPACE)
        sets = [shingles(hashes[first[i] : first[i + 1]], n) for i in range(hi - lo)]
        yield batch.slice(lo, hi - lo), sets, pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def _signatures(batches, n: int):
    for batch in batches:
        for rows, sets, classes in _sets(batch, n):
            full = [s for s in sets if len(s)]
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[1:] = np.cumsum([BANDS if len(s) else 0 for s in sets])
            flat = np.concatenate([bands(s) for s in full]).view(np.int64) if full else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), classes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["row", "doc_id", "n_shingles", "class", "bands"],
            )


def _members(batches, n: int):
    for batch in batches:
        for _, sets, classes in _sets(batch, n):
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[1:] = np.cumsum([len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([classes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["class", "set"])


def _prefixes(batches, frequencies, percent: int):
    """The rarest shingles of each set, as many as a partner of the similarity must hit, with their places."""
    table = frequencies.value
    for batch in batches:
        sets, tokens, places, owners = batch.column("set"), [], [], []
        bounds = sets.offsets.to_numpy()
        bounds, flat = bounds - bounds[0], sets.flatten().to_numpy(zero_copy_only=False)
        for i in range(len(sets)):
            own = flat[bounds[i] : bounds[i + 1]]
            order = np.lexsort((own, table[own & (COUNTERS - 1)]))[: len(own) + len(own) * -percent // 100 + 1]
            tokens.append(own[order])
            places.append(np.arange(len(order)))
            owners.append(np.full(len(order), i))
        if not len(sets):
            continue
        owner = np.concatenate(owners)
        sizes = np.diff(bounds).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(pa.array(owner)), batch.column("component").take(pa.array(owner)), pa.array(sizes[owner]), pa.array(np.concatenate(places).astype(np.int64)), pa.array(np.concatenate(tokens))],
            ["node", "component", "size", "place", "token"],
        )


def rest_pairs(sets: DataFrame, percent: int, save=stored) -> DataFrame:
    """Candidates (a, b) among sets(node, set, component): every pair of different components and the similarity is there."""
    spark = sets.sparkSession
    slots = sets.select(F.explode("set").alias("token")).groupBy(F.col("token").bitwiseAND(COUNTERS - 1).alias("slot")).agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    frequencies = spark.sparkContext.broadcast(table)
    rows = save(map_arrow(sets, lambda it: _prefixes(it, frequencies, percent), "node bigint, component bigint, size bigint, place bigint, token bigint"), "prefixes")
    frequencies.destroy()
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    mixed = save(parts.groupBy("token").agg(F.max_by("component", "n").alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("token", "main"), "mixed-tokens")
    outside = save(rows.join(mixed, "token").filter("component <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "size", "place")]), "outside")
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size") - F.col("place"))
    close = (F.col("component") != F.col("component_a")) & (room * (100 + percent) >= (F.col("size") + F.col("size_a")) * percent)
    met = rows.alias("r").join(outside.alias("o"), (F.col("r.token") == F.col("o.token")) & close)
    return met.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets have 100 x intersection >= percent x union."""
    # a set moves once for each of its few centres; a hot centre's rows can be split
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select("a", "b")


def components(edges: DataFrame, save=stored) -> DataFrame:
    """(node, component) of the nodes of edges(a, b): component is the smallest node reachable.

    Alternates large stars and small stars (each node's larger neighbours, then its smaller ones, are
    linked to its smallest neighbour) until nothing changes; each round is written to the shared folder.
    """

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")

    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True).distinct()
        small = star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).distinct()
        now = save(small, "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    parts = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return parts.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _merged(parts: DataFrame, links: DataFrame, save) -> DataFrame:
    """parts with the components joined that links connect."""
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    joined = save(components(named, save), "joined")
    known = parts.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    known = known.select("node", F.coalesce("whole", "component").alias("component"))
    return known.unionByName(joined).groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, row, first_row) for every row of docs.

    row is row_col, which must differ from row to row, or else a number given here. first_row is the
    row that stands for the component, one of those with the smallest doc_id.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    save = scratch.stored
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = save(map_arrow(texts, lambda it: _signatures(it, n), "row bigint, doc_id bigint, n_shingles bigint, class binary, bands array<bigint>"), "signatures")
    # a class is represented by one of its rows with the smallest id
    one = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    classes = save(signed.filter("class is not null").groupBy("class").agg(one.alias("rep"), F.min("doc_id").alias("rep_id")), "classes")
    # one signature for each representative: the join key has no hot values
    reps = signed.join(classes, (signed["class"] == classes["class"]) & (signed["row"] == classes["rep"])).select("rep", "bands")
    rows = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    # a table of each bucket's facts is stored before it is joined, so that the rows of a hot bucket can be split
    sizes = save(rows.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    rows = save(rows.join(sizes, ["band", "value"]), "shared-buckets")
    # a document in the midst of its copies shares its buckets with most of them: the best centre
    rows = save(rows.join(rows.groupBy("rep").agg(F.sum("n").alias("company")), "rep"), "bucket-rows")
    wanted = save(rows.select("rep").distinct().join(classes, "rep"), "in-buckets")
    # texts of the representatives' ids; their class tells the representatives' own from others with the id
    near = texts.join(wanted.select(F.col("rep_id").alias("doc_id")).distinct().withColumnRenamed("doc_id", "rep_id"), F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi")
    members = map_arrow(near.select("text"), lambda it: _members(it, n), "class binary, set array<bigint>")
    sets = save(members.join(wanted, "class").select(F.col("rep").alias("node"), "set").dropDuplicates(["node"]), "sets")
    # the centre of a bucket: the member that shares its buckets with most
    heads = save(rows.groupBy("band", "value").agg(F.max(F.struct("company", "rep"))["rep"].alias("head")), "heads")
    pairs = rows.join(heads, ["band", "value"]).filter("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    parts = save(components(save(confirm(save(pairs, "pairs"), sets, percent), "links"), save), "parts")
    now = rows.filter("n > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    now = save(now.select("band", "value", "rep", "component"), "labelled")
    mixed = save(now.groupBy("band", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band", "value"), "mixed")
    still = save(now.join(mixed, ["band", "value"]).groupBy(F.col("rep").alias("node")).agg(F.first("component").alias("component")), "open")
    rest = save(confirm(save(rest_pairs(save(sets.join(still, "node"), "open-sets"), percent, save), "rest"), sets, percent), "rest-links")
    if rest.limit(1).count():
        parts = save(_merged(parts, rest, save), "merged")
    # a component's name is its smallest id
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = save(named.select("class", "component", "rep", "rep_id"), "classes-in-components")
    names = named.groupBy("component").agg(F.min("rep_id").alias("component_id"), F.coalesce(F.min_by("rep", "rep_id"), F.min("rep")).alias("first_row"))
    verdicts = save(named.select("class", "component").join(names, "component").select("class", "component_id", "first_row"), "verdicts")
    scratch.clear("signatures", "verdicts")
    out = signed.select("row", "doc_id", "n_shingles", "class").join(verdicts, "class", "left")
    alone = F.col("class").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row", F.when(alone, F.col("row")).otherwise(F.col("first_row")).alias("first_row"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text", n=2)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
