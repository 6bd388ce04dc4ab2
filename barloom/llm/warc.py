"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds every distinct payload once under
its SHA-256; ``records`` holds each record's exact header bytes (WARC header and
HTTP header) with the digest it points at. Of records with equal payloads of at
least ``least`` bytes the one with the smallest page_id is a response and the
others are revisits of it, which hold no payload of their own. A join on the
digest gives any record its bytes back; on the way in, rows of equal digest must
agree in length and SHA-1, and on the way out the payload is digested again.

Hot payloads: one copy a task is kept before the shuffle, and the joins on the
digest can be split.

Defined cases: a null html is the empty payload; a null url leaves its header
line out, line breaks in one become blanks; a null page_id is written as such
and is the smallest of its payload only if there is no other; repeated rows of
one page_id and payload are the same capture, so all of them are responses with
one stored payload. Other columns are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the alphabet of base 32, and that of Spark's conversion to it
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32(hexadecimal: Column) -> Column:
    """Base-32 text (RFC 4648) of 160 bits given as 40 hexadecimal digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS32, BASE32)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary) with its digests and length."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def stored_once(rows: DataFrame) -> DataFrame:
    """One payload a SHA-256, an error where rows of one digest differ in length or SHA-1."""
    same = (F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1"))
    kept = rows.groupBy("sha256").agg(F.any_value("payload").alias("payload"), same.alias("same"))
    # the payload itself hangs on the check, so that no optimizer can leave it out
    return kept.select("sha256", F.when(F.col("same"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads of one digest: "), F.col("sha256"))).cast("binary")).alias("payload"))


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write both tables below ``path``; ``date`` stands in every record."""
    rows = captures(pages)
    stored_once(rows).write.parquet(f"{path}/payloads")
    narrow = rows.drop("payload")
    first = narrow.where(F.col("n") >= least).groupBy("sha256").agg(F.min("page_id").alias("first"))
    joined = narrow.join(first, "sha256", "left")
    revisit = (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    named = joined.select("*", revisit.alias("revisit"), http.alias("http"))
    block = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("n"))
    lines = F.concat_ws(
        END, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(F.col("revisit"), F.concat_ws(END, F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first"))))),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")), F.lit(END))
    named.select("page_id", "sha256", lines.cast("binary").alias("warc"), F.col("http").cast("binary").alias("http")).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, its header bytes and its full payload, which must have the digest it is stored under."""
    records = spark.read.schema("page_id long, sha256 string, warc binary, http binary").parquet(f"{path}/records")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload is missing or altered: "), F.col("sha256"))).cast("binary"))
    return records.join(payloads, "sha256", "left").select("page_id", "warc", "http", checked.alias("payload"))


def written(record: DataFrame) -> DataFrame:
    """page_id and the bytes of each record as it stands in the archive: a revisit without payload."""
    body = F.when(_field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return record.select("page_id", F.concat("warc", "http", body, F.lit(END + END).cast("binary")).alias("data"))


def captured(record: DataFrame) -> DataFrame:
    """page_id and the HTTP response of each capture, a revisit's with the payload it refers to."""
    return record.select("page_id", F.concat("http", "payload").alias("data"))


def _field(name: str) -> Column:
    head = F.col("warc").cast("string")
    return F.nullif(F.regexp_extract(head, f"(?m)^{name}: ([^\\r\\n]*)", 1), F.lit(""))


def describe(record: DataFrame) -> DataFrame:
    """Per record: length and digest of the payload read back, and what its header says."""
    refers = F.nullif(F.regexp_extract(F.coalesce(_field("WARC-Refers-To"), F.lit("")), "<urn:page:(-?[0-9]+)>", 1), F.lit(""))
    return record.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), refers.cast("long").alias("refers_to"))
