"""Content-addressed WARC archive.

An archive folder holds two tables. payloads: every distinct payload once, keyed by its SHA-256,
which is checked when it is read. headers: for each record its exact header bytes and the key of its
payload. Records are rebuilt by joining the two; the first page with a payload is a response, the
others revisit it. export_text() writes the same records as WARC text for other readers.

A record's id is its page's id and a number of the archive, so that equal rows differ in it.

Defined cases: a null html is the empty payload; a null url is about:blank; a null page_id is written
as an empty id and sorts first; equal rows (same id and payload) are one response and, for each
further copy, a revisit of that same page; an empty table gives empty tables; only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table, stored

CRLF = "\r\n"
#: The base32 alphabet, in the order of its digits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Payloads shorter than this are stored as responses even when they repeat.
LEAST_REVISIT_BYTES = 0
#: The capture time written where none is given.
NO_DATE = "1970-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit hex digest: each 5 hex digits are 20 bits, 4 base32 digits."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), DIGITS32, BASE32)


def _header(date: str) -> Column:
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    ident = lambda page, number: F.concat(F.lit("<urn:rangeflow:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", ident(F.col("page_id"), F.col("number"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", "")),
        F.when(revisit, line("WARC-Refers-To", ident(F.col("first_id"), F.col("first_number")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1_base32"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def write_archive(pages: DataFrame, id_col: str, url_col: str, html_col: str, folder: str, least: int = LEAST_REVISIT_BYTES, date: str = NO_DATE) -> None:
    """Writes folder/headers and folder/payloads."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("key", F.sha2("payload", 256))
    meta = rows.select("page_id", "url", "key", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("sha1_base32"))
    meta = stored(meta.withColumn("number", F.monotonically_increasing_id()), "warc-meta")
    # struct order: a null id first, then the smallest
    first = meta.groupBy("key").agg(F.min(F.struct("page_id", "number")).alias("first"), F.count("*").alias("records"))
    first = stored(first.select("key", F.col("first.page_id").alias("first_id"), F.col("first.number").alias("first_number"), "records"), "warc-first")
    # one payload row for each key: joined on (key, id), which has no hot values, and made distinct where it stands
    ident = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id")
    kept = rows.select("key", ident("page_id"), "payload").join(first.select("key", ident("first_id")), ["key", "id"]).dropDuplicates(["key", "id"])
    kept.select("key", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    joined = meta.join(first.filter("records > 1").select("key", "first_id", "first_number"), "key", "left")
    revisit = F.col("first_number").isNotNull() & (F.col("first_number") != F.col("number")) & (F.col("payload_bytes") >= least)
    joined = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    joined.select("page_id", "key", _header(date).cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record rebuilt: (page_id, header, payload); payloads are checked against their key."""
    checked = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("key"))).cast("binary"))
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("payload", checked)
    return spark.read.parquet(f"{folder}/headers").join(payloads, "key").select("page_id", "header", "payload")


def header_field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\n{name}: ?([^\r]*)\r\n", 1), F.lit(""))


def export_text(records: DataFrame, path: str) -> None:
    """The records as WARC files: header, empty line, payload (none in a revisit), two line ends."""
    body = F.when(header_field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    records.select(F.concat(F.col("header").cast("string"), F.lit(CRLF), body).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), "page_id", "url", "html", folder)
    records = read_archive(spark, folder)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+):\d+>", 1)
    return records.select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        F.nullif(number(header_field("WARC-Refers-To")), F.lit("")).cast("bigint").alias("refers_to"),
    )


_HEX5 = "list_transform(range(8), lambda i: ('0x' || substr(sha1(payload), (5 * i + 1)::int, 5))::bigint)"
OP6_SQL = f"""
with rows as (select page_id, encode(coalesce(html, '')) as payload from pages),
firsts as (select payload, min(page_id) as first_id from rows group by payload)
select r.page_id, octet_length(r.payload)::bigint as payload_bytes,
       list_aggregate(flatten(list_transform({_HEX5.replace("payload", "r.payload")},
           lambda v: [substr('{BASE32}', ((v >> 15) & 31)::int + 1, 1), substr('{BASE32}', ((v >> 10) & 31)::int + 1, 1),
                 substr('{BASE32}', ((v >> 5) & 31)::int + 1, 1), substr('{BASE32}', (v & 31)::int + 1, 1)])), 'string_agg', '') as payload_digest,
       case when r.page_id = f.first_id then 'response' else 'revisit' end as record_type,
       case when r.page_id <> f.first_id then f.first_id end as refers_to
from rows r join firsts f on r.payload = f.payload
"""
