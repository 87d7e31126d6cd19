"""A content-addressed WARC archive.

``archive`` stores each payload once, under its SHA-256, and the exact header text of
every record in a table of its own.  ``payloads`` reads the stored bytes back and checks
that they still have the digests they are filed under; ``records`` joins headers and
payloads into the original records, byte for byte.

Of the records with equal payloads the one with the largest page_id is the response and
holds the payload; the others are revisits that refer to it.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other
and written as ``page:`` without a number; a null url is an empty target, and line ends in a
url are written as %0D and %0A, so no url can add a header; a very long payload is one value
of its row; a page repeated in full is a response each time if it is the largest, the payload is stored once all the
same; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import work_folder
from codeaudit.llm.common import table

#: Payloads of fewer bytes are always stored with their own record.
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32: five hexadecimal digits are four characters."""
    digest = F.sha1(data)
    out = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(ALPHABET), at, F.lit(1)))
    return F.concat(*out)


def _number(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit(""))


def _on_one_line(value: Column) -> Column:
    """A header value without line ends, which would begin a header of their own."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _http_head(size: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"), F.lit("\r\n\r\n"),
    )


def _header(kind: str, refers: Column) -> Column:
    """Header text of a record, up to and with the blank line, then the HTTP head of its block."""
    http = _http_head(F.col("payload_bytes"))
    length = F.octet_length(http)
    if kind == "response":
        extra, length = F.lit(""), length + F.col("payload_bytes")
    else:
        extra = F.concat(
            F.lit("WARC-Refers-To: <urn:page:"), _number(refers),
            F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"),
        )
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"),
        _number(F.col("page_id")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        _on_one_line(F.coalesce("url", F.lit(""))),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\n"), extra,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"), F.lit("\r\n\r\n"), http,
    )


def archive(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``folder``/payloads and ``folder``/headers.

    Copies of a payload meet in partial aggregates first, so a payload that a third of all
    pages share leaves each task once.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(
        "page_id", "url", payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("sha256"),
    )
    (
        hashed.groupBy("sha256")
        .agg(F.max(F.struct("page_id", "payload")).alias("kept"))
        .select(
            "sha256", F.col("kept.page_id").alias("stored_by"),
            F.col("kept.payload").cast("binary").alias("payload"),
        )
        .write.parquet(f"{folder}/payloads")
    )
    spark = pages.sparkSession
    stored = spark.read.parquet(f"{folder}/payloads").select("sha256", "stored_by")
    slim = hashed.select(
        "page_id", "url", "sha256",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"),
    )
    joined = slim.join(stored, "sha256")
    own = F.col("page_id").eqNullSafe(F.col("stored_by")) | (F.col("payload_bytes") < min_bytes)
    (
        joined.select(
            "page_id", "sha256",
            F.when(own, _header("response", F.col("stored_by")))
            .otherwise(_header("revisit", F.col("stored_by"))).alias("header"),
        )
        .write.parquet(f"{folder}/headers")
    )


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads with the digests of the bytes read; a wrong filing digest is an error."""
    read = spark.read.parquet(f"{folder}/payloads")
    found = F.sha2("payload", 256)
    wrong = F.concat(F.lit("payload does not have its digest: "), F.col("sha256"))
    return read.select(
        F.when(found == F.col("sha256"), F.col("sha256"))
        .otherwise(F.raise_error(wrong).cast("string")).alias("sha256"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header rows with the fields that their text holds."""
    number = r"<urn:page:(-?\d+)>"
    return spark.read.parquet(f"{folder}/headers").select(
        "sha256", "header",
        F.expr(f"try_cast(regexp_extract(header, '\\\\r\\\\nWARC-Record-ID: {number}', 1) as long)".replace(r"\d", r"\\d")).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.expr(f"try_cast(regexp_extract(header, '\\\\r\\\\nWARC-Refers-To: {number}', 1) as long)".replace(r"\d", r"\\d")).alias("refers_to"),
        F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)", 1)
        .alias("stated_digest"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The WARC records as bytes, each closed by two line ends, with the fields of their headers."""
    joined = headers(spark, folder).join(payloads(spark, folder), "sha256")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(
        F.lit(b"")
    )
    return joined.select(
        "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest",
        F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"),
        (F.octet_length(F.substring_index("header", "\r\n\r\n", 1)) + 4).alias("header_bytes"),
        F.regexp_extract("header", r"\r\nContent-Length: (\d+)", 1).cast("long").alias("stated_bytes"),
    )


def pages_back(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload): what every page held, revisits through the payload they refer to."""
    held = payloads(spark, folder).select("sha256", "payload")
    return headers(spark, folder).join(held, "sha256").select("page_id", "payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    archive(table(spark, sf_dir, "pages"), folder)
    block = F.octet_length("record") - F.col("header_bytes") - 4
    return records(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        (F.col("stated_digest") == F.col("payload_digest")).alias("digest_agrees"),
        (block == F.col("stated_bytes")).alias("length_agrees"),
    )
