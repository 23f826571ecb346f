"""Hard negatives by product quantisation with stored residual norms.

A vector is cut into pieces of a few dimensions; each piece is coded by its nearest centroid, and the
norm of what the centroid leaves over is stored beside the code, rounded up. A lookup table of an
anchor's products with all centroids gives a score for every row, and by Cauchy-Schwarz in each piece
the true score lies within the sum of the pieces' norms times the residual norms. Rows whose bounds
exclude them are filtered; exact integer scores complete each window.

Rows and anchors are dealt into blocks of bounded size, and each block of anchors meets each block of
rows once: all blocks for the negatives, those of its own label for the positives. A meeting returns
only the few best rows of each window, so ties and hot labels or vectors cost no more than others.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part;
rows with a null id are ranked behind others and are no anchors; repeated rows are rows of their own,
as anchors too; an anchor without another row of its label, or a positive without a row in its
window, has no result; vectors of different lengths are a ValueError; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stored, unit_hash

#: Dimensions of a piece, and centroids for each piece.
PIECE, CENTROIDS = 4, 256
#: The centroids are fitted on about so many rows (a bounded sample); every row is coded, and results don't depend on it.
FIT_ROWS, FIT_STEPS = 8192, 8
#: Rows and anchors of a block, and anchors of it that are bounded at once.
ROW_BLOCK, ANCHOR_BLOCK, STEP = 8192, 4096, 64

POSITIVE_NAMES = ["anchor_row", "positive_id", "positive_score"]
POSITIVES = "anchor_row bigint, positive_id bigint, positive_score bigint"
NEGATIVE_NAMES = ["anchor_row", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score"]
NEGATIVES = "anchor_row bigint, anchor_id bigint, positive int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def finite(vector: Column) -> Column:
    """Whether vector is there and all its components are numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component), with components taken as doubles."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


# -- quantisation ----------------------------------------------------------------------------------


def pieces(x: np.ndarray) -> np.ndarray:
    """rows x pieces x PIECE, filled up with zeros."""
    count = -(-x.shape[1] // PIECE)
    out = np.zeros((len(x), count * PIECE))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), count, PIECE)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def fit_centroids(x: np.ndarray) -> np.ndarray:
    """pieces x centroids x PIECE by k-means on each piece of the sample."""
    cut, rng = pieces(x), np.random.default_rng(11)
    starts = cut[rng.permutation(len(cut))[:CENTROIDS]]
    out = np.ascontiguousarray(starts.transpose(1, 0, 2))
    for k, centroids in enumerate(out):
        for _ in range(FIT_STEPS):
            code = nearest(cut[:, k], centroids)
            sizes = np.bincount(code, minlength=len(centroids))
            sums = np.stack([np.bincount(code, cut[:, k, j], len(centroids)) for j in range(PIECE)], axis=1)
            centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return out


def encode(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms rounded up) of rows x pieces."""
    cut = pieces(x)
    codes = np.stack([nearest(cut[:, k], c) for k, c in enumerate(centroids)], axis=1).astype(np.uint8)
    residual = np.linalg.norm(cut - centroids[np.arange(len(centroids)), codes], axis=2)
    return codes, np.nextafter((residual * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def bounds(q: np.ndarray, codes: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of anchors x rows."""
    cut = pieces(q)
    tables = np.einsum("apj,pcj->pac", cut, centroids)
    score = np.zeros((len(q), len(codes)))
    for table, code in zip(tables, codes.T, strict=True):
        score += np.take(table, code, axis=1)
    reach = np.linalg.norm(cut, axis=2) @ norms.T.astype(np.float64)
    # rounding of the sums: far more than they can lose
    lost = 1e-12 * np.abs(cut).sum(axis=(1, 2)) * (np.abs(centroids).max() + norms.max(initial=0)) * len(centroids) + 1e-6
    return score - reach - lost[:, None], score + reach + lost[:, None]


# -- a block of anchors against a block of rows --------------------------------------------------------


class Block:
    """A group's Arrow table as arrays."""

    def __init__(self, table: pa.Table, vector: str, width: str):
        self.n = table.num_rows
        self.table = table
        self.x = self._binary(vector, width)

    def _binary(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.table.column(name).to_pylist()), kind).reshape(self.n, -1) if self.n else np.zeros((0, 0), kind)

    def numbers(self, name: str, missing: int = np.iinfo(np.int64).max) -> np.ndarray:
        return self.table.column(name).fill_null(missing).to_numpy()

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        return self._binary("codes", "u1"), self._binary("norms", "<f4")


def exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs (a, r)."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 1 << 15):
        some = slice(lo, lo + (1 << 15))
        out[some] = np.einsum("ij,ij->i", q[a[some]].astype(np.int64), x[r[some]].astype(np.int64))
    return out


def floors(lower: np.ndarray, most: int) -> np.ndarray:
    """The most-th largest lower bound of each anchor: a row that can't reach it isn't among the first."""
    if lower.shape[1] <= most:
        return np.full(len(lower), -np.inf)
    return np.partition(lower, lower.shape[1] - most, axis=1)[:, lower.shape[1] - most]


def first(a: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each anchor's first pairs: higher scores first, ties by smaller id."""
    order = np.lexsort((ids[r], -score, a))
    starts = np.searchsorted(a[order], a[order], "left")
    return order[np.arange(len(order)) - starts < most]


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max)


def _positives(rows: pa.Table, anchors: pa.Table, centroids, width: str, most: int) -> pa.Table:
    rows, anchors = Block(rows, "x", width), Block(anchors, "anchor_x", width)
    found = [(np.zeros(0, np.int64),) * 3]
    if rows.n and anchors.n:
        (codes, norms), row, ids, own = rows.codes(), rows.numbers("row"), rows.numbers("vec_id"), anchors.numbers("anchor_row")
        for lo in range(0, anchors.n, STEP):
            q, me = anchors.x[lo : lo + STEP], own[lo : lo + STEP]
            lower, upper = bounds(q, codes, norms, centroids.value)
            other = row != me[:, None]
            lower[~other] = -np.inf
            a, r = np.nonzero(other & (upper >= floors(lower, most)[:, None]))
            score = exact(q, rows.x, a, r)
            at = first(a, r, score, ids, most)
            found.append((me[a[at]], ids[r[at]], score[at]))
    anchor, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table([pa.array(anchor), _ids(ids), pa.array(score)], POSITIVE_NAMES)


def _negatives(rows: pa.Table, anchors: pa.Table, centroids, width: str, most: int, low: int, high: int) -> pa.Table:
    rows, anchors = Block(rows, "x", width), Block(anchors, "anchor_x", width)
    out = [pa.table([pa.array([], pa.int32() if n == "positive" else pa.int64()) for n in NEGATIVE_NAMES], NEGATIVE_NAMES)]
    if rows.n and anchors.n:
        (codes, norms), ids, labels = rows.codes(), rows.numbers("vec_id"), rows.numbers("label")
        own = [anchors.numbers(f"anchor_{c}") for c in ("row", "vec_id", "label")]
        lists = anchors.table.column("positives").to_pylist()
        for lo in range(0, anchors.n, STEP):
            q, (me, my_id, my_label) = anchors.x[lo : lo + STEP], (o[lo : lo + STEP] for o in own)
            lower, upper = bounds(q, codes, norms, centroids.value)
            other = labels != my_label[:, None]
            for k in range(max(map(len, lists[lo : lo + STEP]))):
                has = np.array([len(p) > k for p in lists[lo : lo + STEP]])
                score = np.array([p[k]["score"] if len(p) > k else 0 for p in lists[lo : lo + STEP]], np.int64)
                positive = np.array([p[k]["id"] if len(p) > k and p[k]["id"] is not None else np.iinfo(np.int64).max for p in lists[lo : lo + STEP]], np.int64)
                least, top = (low * score / 100)[:, None], (high * score / 100)[:, None]
                inside = other & has[:, None] & (upper >= least) & (lower <= top)
                # rows that are certainly in the window set the score that others must be able to reach
                certain = np.where(inside & (lower >= least) & (upper <= top), lower, -np.inf)
                a, r = np.nonzero(inside & (upper >= floors(certain, most)[:, None]))
                value = exact(q, rows.x, a, r)
                fits = (low * score[a] <= 100 * value) & (100 * value <= high * score[a])
                a, r, value = a[fits], r[fits], value[fits]
                at = first(a, r, value, ids, most)
                a, r, value = a[at], r[at], value[at]
                columns = [pa.array(me[a]), _ids(my_id[a]), pa.array(np.full(len(a), k, np.int32)), _ids(positive[a]), pa.array(score[a]), _ids(ids[r]), pa.array(value)]
                out.append(pa.table(columns, NEGATIVE_NAMES))
    return pa.concat_tables(out)


# -- operator ----------------------------------------------------------------------------------------


def hard_negatives(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for integer vectors.

    The positives of an anchor are its first rows of the same label; the negatives of a positive are
    the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vector_col}`").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = stored(rows.filter("label is not null and x is not null and size(filter(x, c -> c is null)) = 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    size, largest = F.size("x"), F.aggregate("x", F.lit(0).cast("bigint"), lambda m, c: F.greatest(m, F.abs(c)))
    n, asked, shortest, longest, top = rows.agg(F.count("*"), F.count_if("anchor"), F.min(size), F.max(size), F.max(largest)).first()
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not asked or not longest:
        return empty
    if shortest != longest:
        raise ValueError(f"{vector_col} has vectors of {shortest} to {longest} components")
    width = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    share = FIT_ROWS / n
    sample = np.array([r[0] for r in rows.filter(unit_hash(F.col("row"), seed="centroids") < share).select("x").collect()] or [rows.select("x").first()[0]], np.float64)
    centroids = spark.sparkContext.broadcast(fit_centroids(sample))  # components x CENTROIDS x 8 bytes

    def coded(batches):
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, longest), np.int64)
            codes, norms = encode(x, centroids.value)
            data = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (x.astype(width), codes, norms.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "anchor")), *data], ["row", "vec_id", "label", "anchor", "x", "codes", "norms"])

    coded_rows = stored(map_arrow(rows, coded, "row bigint, vec_id bigint, label bigint, anchor boolean, x binary, codes binary, norms binary"), "coded")
    asking = coded_rows.filter("anchor").select(*[F.col(c).alias(f"anchor_{c}") for c in ("row", "vec_id", "label", "x")])
    rows = coded_rows.drop("anchor")

    # a label's rows and anchors in blocks of their own
    labels = coded_rows.groupBy("label").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("chunks"), F.ceil(F.count_if("anchor") / ANCHOR_BLOCK).alias("blocks"))
    labels = stored(labels.filter("blocks > 0"), "labels")
    left = rows.join(labels, "label").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks")
    right = asking.join(labels, F.col("anchor_label") == F.col("label")).withColumn("block", F.pmod(F.xxhash64("anchor_row"), "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks")
    right = right.select(F.col("label").alias("of"), F.col("chunk").alias("with_chunk"), F.col("block").alias("in_block"), "anchor_row", "anchor_x")
    near = left.groupBy("label", "chunk", "block").cogroup(right.groupBy("of", "with_chunk", "in_block")).applyInArrow(lambda a, b: _positives(a, b, centroids, width, positives), POSITIVES)
    along = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    near = near.withColumn("k", F.row_number().over(along)).filter(F.col("k") <= positives)
    near = stored(near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("k", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives")), "positives")

    chunks, blocks = -(-n // ROW_BLOCK), -(-asked // ANCHOR_BLOCK)
    left = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asking.join(near, "anchor_row").withColumn("block", F.pmod(F.xxhash64("anchor_row"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = right.withColumnsRenamed({"chunk": "with_chunk", "block": "in_block"})
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("with_chunk", "in_block")).applyInArrow(lambda a, b: _negatives(a, b, centroids, width, negatives, low, high), NEGATIVES)
    along = Window.partitionBy("anchor_row", "positive").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= negatives)
    return found.select(*empty.columns)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").filter(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    table = table.select("vec_id", integers(F.col("embedding")).alias("x"), label.alias("label"))
    return hard_negatives(table, "vec_id", "x", "label", F.col("vec_id") % 100 == 0)


OP11_SQL = """
with vectors as materialized (
    select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda c: floor(256 * c::double)) as x
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pairs as materialized (
    select a.row as anchor_row, a.vec_id as anchor_id, a.label = b.label as same, b.row, b.vec_id, list_inner_product(a.x, b.x)::bigint as score
    from vectors a join vectors b on a.row <> b.row where a.vec_id % 100 = 0),
positives as (
    select *, row_number() over (partition by anchor_row order by score desc, vec_id, row) as k from pairs where same qualify k <= 5),
windows as (
    select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
           row_number() over (partition by p.anchor_row, p.k order by n.score desc, n.vec_id) as rank
    from positives p join pairs n on p.anchor_row = n.anchor_row and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from windows where rank <= 5
"""
