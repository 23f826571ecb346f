"""A training-corpus pipeline over documents: toxicity, near duplicates, contamination, mix, token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads
it again as the next stage's docs. All but the last return the columns of documents, and extra ones
that docs has. Decisions are made for rows, so repeated and null ids go the way of their own texts:
of equal rows one stays. Null texts follow the operators' defined cases: they are not toxic, nobody's
duplicates and clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm import decontaminate, minhash, mixing, tokenstore, toxicity
from rangeflow.llm.common import crc_remainder, read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores below 0.5; it learns from the labels of these documents."""
    learn = crc_remainder(F.col("doc_id"), 5) != 0
    machine = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", learn)
    return toxicity.without_toxic(docs, "text", machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8 or more."""
    docs, row = _numbered(docs)
    found = minhash.near_duplicates(docs, "doc_id", "text", row_col=row)
    copies = stored(found.filter("row <> first_row").select(F.col("row").alias(f"{row}_of")), "copies")
    return docs.join(copies, F.col(row) == F.col(f"{row}_of"), "left_anti").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_hits(docs, "text", read_table(spark, sf_dir, "benchmark"), "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as it was drawn."""
    docs, row = _numbered(docs)
    drawn = mixing.mix(docs, "doc_id", "text", "source", row_col=row).filter("copies <> 1").select(F.col("row").alias(f"{row}_of"), F.col("copies").alias(f"{row}_copies"))
    joined = docs.join(stored(drawn, "drawn"), F.col(row) == F.col(f"{row}_of"), "left")
    repeats = F.array_repeat(F.lit(1), F.coalesce(f"{row}_copies", F.lit(1)))
    return joined.withColumn(f"{row}_copy", F.explode(repeats)).select([c for c in docs.columns if c != row])


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the content-addressed store, read back and verified: a row for each document."""
    return tokenstore.token_store(docs, tokenstore.word_bpe_path()).drop("ids")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written, with a number for each row in a column of the name returned."""
    row = "row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row = f"_{row}"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("token_store", store_tokens),
]

#: The toxicity stage learns a model, which SQL can't express; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
