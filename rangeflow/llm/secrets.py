"""Secret scans with an incremental blob ledger.

Every historical version of a text is a blob, named by the SHA-256 of its content. A ledger keeps
which (blob, rule version) pairs have been scanned and what was found; a run scans only unseen pairs
and joins the findings back to all paths of a blob. DataFrame functions only.

Defined cases: a null text is the empty blob; equal rows share a blob and each gets its row back; a
null path is kept; an empty table gives empty tables; only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .common import new_path, read_table, stored


@dataclass(frozen=True)
class Rule:
    """kind: its name; version: raise it when the pattern changes, so that all blobs are scanned anew.

    measured: the group whose length must reach least, or the match itself (0). base: whether its
    spans belong to the base spans, which rules added later leave as they are.
    """

    kind: str
    version: int
    pattern: str
    least: int
    measured: int = 0
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns, in the order in which kinds sort.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),  # the runs of [0-9a-f]+ that are long enough
)

SCANNED = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType())])
FINDINGS = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("kind_no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def find_spans(texts: DataFrame, rules=RULES) -> DataFrame:
    """FINDINGS rows for texts(blob, text, todo), todo being the rule keys to apply.

    Matches are leftmost and non-overlapping for each rule. Offsets are code points, the end
    exclusive: the text between matches comes from split() with the same pattern, and running sums
    of the two lengths give the places, so a text with many matches costs linear time.
    """
    found = None
    for no, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        hits = texts.filter(F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern))
        pieces = F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length).alias("hit"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.measured)), F.length).alias("measured"),
        )
        rows = hits.select("blob", F.posexplode(pieces).alias("n", "p")).filter(F.col("p.hit").isNotNull())
        order = "partition by blob order by n rows between unbounded preceding and current row"
        rows = rows.select("blob", "n", F.col("p.gap").alias("gap"), F.col("p.hit").alias("hit"), F.col("p.measured").alias("measured"))
        rows = rows.withColumn("end", F.expr(f"sum(cast(gap as bigint) + hit) over ({order})"))
        rows = rows.filter(F.col("measured") >= rule.least).select(
            "blob", F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(no).alias("kind_no"), (F.col("end") - F.col("hit")).alias("start"), "end"
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def scan_versions(versions: DataFrame, path_col: str, text_col: str, ledger: str, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger folder has not seen; returns (paths(path, blob), findings of the ledger).

    versions holds one row for each path and version. The ledger's tables are only appended to;
    findings are written before the pairs are marked, and a pair scanned twice after a failure in
    between gives the same rows, which are read distinct.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    paths = stored(rows.select("path", blob_of(F.col("text")).alias("blob")), "paths")
    todo = (
        paths.groupBy("blob").agg(F.min("path").alias("path"))
        .withColumn("rule", F.explode(F.array(*[F.lit(r.key) for r in rules])))
        .join(_ledger(spark, f"{ledger}/scanned", SCANNED), ["blob", "rule"], "left_anti")
    )
    todo = stored(todo.groupBy("blob", "path").agg(F.collect_set("rule").alias("todo")), "todo")
    # one holder's text stands for the blob; the join key (blob, path) has no hot values
    texts = (
        rows.withColumn("blob", blob_of(F.col("text"))).alias("v")
        .join(todo.alias("t"), (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.path")))
        .select("v.blob", "v.text", "t.todo")
    )
    if rules:
        matching = None
        for r in rules:
            one = F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern)
            matching = one if matching is None else matching | one
        # only texts with a match move on; equal rows of one path are one blob
        texts = stored(texts.filter(matching), "texts").dropDuplicates(["blob"])
        find_spans(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{ledger}/scanned")
    keys = [r.key for r in rules]
    return paths, _ledger(spark, f"{ledger}/findings", FINDINGS).filter(F.col("rule").isin(keys)).distinct()


def summarise(paths: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """A row for each path with its counts for each kind, all spans and the digest of the base spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base, counts = [r.kind for r in rules if r.base], [f"n_{r.kind}" for r in rules]
    # the rows of a group are one text's findings
    blobs = findings.groupBy("blob").agg(
        *[F.sum((F.col("kind") == r.kind).cast("bigint")).alias(f"n_{r.kind}") for r in rules],
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("all"),
    )
    blobs = blobs.select("blob", *counts, joined(F.col("all")).alias("spans"), joined(F.filter("all", lambda x: x["kind"].isin(base))).alias("base"))
    known = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    return paths.join(blobs, "blob", "left").select(
        "path", "blob", *[known(c, 0).cast("bigint").alias(c) for c in counts], known("spans", "").alias("spans"), F.sha2(known("base", "").cast("binary"), 256).alias("base_sha256")
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, findings = scan_versions(read_table(spark, sf_dir, "documents"), "doc_id", "text", new_path(spark, "ledger"))
    return summarise(paths, findings).select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
