"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256; record headers are stored apart and
exactly, each with the digest of its payload.  Reading verifies a payload's SHA-256, SHA-1
and size against its key and the headers, and joins rebuild the original records.  Both
tables are Parquet, written and read by Spark, so they live in any store.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:thicket:record:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Bare base32 of a 40-digit hex column: 15 hex digits are 12 digits to the base of 32."""
    parts = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def one_line(url: Column) -> Column:
    """A url without control characters and spaces, which are percent-encoded: a header's field is one line."""
    plain = F.coalesce(url, F.lit(""))
    sign = lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(plain.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(plain, ""), sign), "")).otherwise(plain)


def _record_id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<" + _URN), page.cast("string"), F.lit(":"), digest, F.lit(">"))


def _header(kind: str, date: str) -> Column:
    """The record's header, to its empty line."""
    lines = [
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
    ]
    if kind == "revisit":
        lines += [F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id"), F.col("digest"))), F.lit(f"WARC-Profile: {_PROFILE}"), F.lit("Content-Length: 0")]
    else:
        lines += [F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.col("size").cast("string"))]
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str | None = None) -> None:
    """Writes ``path``/payloads (sha256, size, payload) and ``path``/records (page_id, sha256, header).

    pages: page_id, url, html (null: empty; in UTF-8); every row is a record.  Of records with
    equal payloads of at least ``min_revisit_bytes``, that with the least page_id is the
    response; smaller ones are all responses.  Rows with a null page_id are left out.  A row
    repeated in full, or with another url alone, is a record again of the same kind; rows of
    one page_id with different html are records of their own, told apart by their payload's
    digest.  Control characters and spaces in urls are percent-encoded.  date: WARC-Date of
    the records (if not given, the time of writing).  Extra columns are ignored.
    """
    C.prepare(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keys = whole.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")).checkpoint()
    least = keys.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).checkpoint()
    # only the first page of each digest sends its payload
    firsts = whole.join(least.select(F.col("first_id").alias("page_id"), F.col("sha256").alias("wanted")), "page_id")
    payloads = firsts.withColumn("sha256", F.sha2("payload", 256)).where("sha256 = wanted").dropDuplicates(["page_id", "sha256"])  # one for each digest, where the join has left them
    payloads.select("sha256", F.octet_length("payload").cast("long").alias("size"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    own = C.spread_join(keys, least.drop("n"), ["sha256"], C.hot_keys(least, ["sha256"], "n"), ["page_id"]).withColumn("digest", base32_of_hex(F.col("sha1")))
    is_revisit = (F.col("page_id") != F.col("first_id")) & (F.col("size") >= min_revisit_bytes)
    own.select("page_id", "sha256", F.when(is_revisit, _header("revisit", date)).otherwise(_header("response", date)).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: {pattern}\r\n", 1)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The archive's records (page_id, record_type, refers_to, digest, sha256, header) and payloads (sha256, size, payload).

    What a record is comes from its header alone; page_id and sha256 beside it are keys.
    """
    records = spark.read.parquet(f"{path}/records")
    records = records.select(
        _field("WARC-Record-ID", f"<{_URN}(-?[0-9]+):[A-Z2-7]+>").cast("long").alias("page_id"),
        F.regexp_extract(F.col("header").cast("string"), r"^WARC/1\.1\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
        F.nullif(_field("WARC-Refers-To", f"<{_URN}(-?[0-9]+):[A-Z2-7]+>"), F.lit("")).cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("digest"),
        "sha256",
        "header",
    )
    return records, spark.read.parquet(f"{path}/payloads")


def verified(payloads: DataFrame) -> DataFrame:
    """Payloads with their SHA-1 (bare base32); one whose SHA-256 or size isn't its key's stops the reading."""
    fine = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("size"))
    payload = F.when(fine, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is changed: "), F.col("sha256"))).cast("binary"))
    return payloads.select("sha256", "size", payload.alias("payload")).withColumn("sha1", base32_of_hex(F.sha1("payload")))


def _matched(heads: DataFrame, stored: DataFrame) -> DataFrame:
    """Records with what is stored under their digests; a payload that is missing or not the header's stops the reading."""
    counted = heads.groupBy("sha256").agg(F.count("*").alias("n"))
    joined = C.spread_join(heads, stored, ["sha256"], C.hot_keys(counted, ["sha256"], "n"), ["page_id"], "left")
    right = F.coalesce(F.col("sha1") == F.col("digest"), F.lit(False))
    return joined.withColumn("digest", F.when(right, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload of page "), F.col("page_id").cast("string"), F.lit(" is missing or changed")))))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records rebuilt: page_id, record (header, payload of responses, two line ends)."""
    heads, payloads = read(spark, path)
    end = F.lit("\r\n\r\n").cast("binary")
    responses = _matched(heads.where("record_type = 'response'"), verified(payloads)).where("digest is not null").select("page_id", F.concat("header", "payload", end).alias("record"))
    return responses.unionByName(heads.where("record_type = 'revisit'").select("page_id", F.concat("header", end).alias("record")))


def digest_table(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from an archive.

    Bytes and digests are those of the stored payloads, each read and verified once.
    """
    heads, payloads = read(spark, path)
    stored = verified(payloads).select("sha256", "sha1", "size")
    return _matched(heads.drop("header"), stored).select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` in the shared checkpoint folder, reads the archive back and removes it: digest_table's columns."""
    spark = pages.sparkSession
    C.prepare(spark)
    path = f"{C.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write(pages, path, min_revisit_bytes)
        return digest_table(spark, path).checkpoint()
    finally:
        C.remove(spark, path)
