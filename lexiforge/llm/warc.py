"""Content-addressed WARC archive in two tables, with built-in functions only.

``payloads(digest, payload)`` holds each distinct payload once under its SHA-256; ``headers`` holds the exact
record header of every page. :func:`write_archive` writes both, :func:`read_archive` reads them back, joins
them on the digest, rebuilds each record, and verifies every stored payload against its key.

A payload that many pages share is read, hashed and checked once, on the payload side of the join. What the
join deals out by digest are short header rows, and it is a plain equi-join, whose hot partitions Spark splits.
Who is response: one row per digest, pre-aggregated before the shuffle.

Defined cases: null html is the empty payload; a null URL gives an empty target; repeated page ids with equal
payloads are all response when they carry the largest id; a row without page_id is a record without a number, which revisits
the page of the same payload if one has a number, and is a response else; an empty table gives an empty archive; of the
input only page_id, url and html are read, so clashing names do no harm. A payload that does not have its digest any more
makes reading the records fail; ``read_archive`` reports it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import shared_folder

#: The record format's version and revisit profile, and the base32 alphabet.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, by twenty bits (five hex digits, four letters) at a time."""
    digest = F.sha1(payload)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_header(fields: list[tuple[str, Column]]) -> Column:
    """Version line and ``name: value`` lines, each ended by CR LF, then a blank line. Null values are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in fields]
    return F.concat(F.lit(VERSION + END), *lines, F.lit(END))


def header_field(header: Column, name: str) -> Column:
    """The value of a header field, or null."""
    found = F.regexp_extract(header, rf"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"\r\n{name}: ")), found)


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def write_archive(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Writes ``pages(page_id, url, html)`` to ``folder``/payloads and ``folder``/headers.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest page_id is
    response and the others revisit it; every shorter payload is a response of its own.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n_bytes")
    )
    owner = keyed.groupBy("digest").agg(F.max("page_id").alias("owner"))
    facts = keyed.select("page_id", "url", "digest", "n_bytes", base32_sha1(F.col("payload")).alias("sha1"))
    # a row without number is no owner, but that of a digest whose rows have none
    revisit = ~F.col("page_id").eqNullSafe(F.col("owner")) & (F.col("n_bytes") >= min_revisit_bytes)
    record_id = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = record_header(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(F.col("page_id"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, record_id(F.col("owner")))),
            ("Content-Type", F.when(~revisit, "text/html; charset=UTF-8")),
            ("Content-Length", F.when(revisit, 0).otherwise(F.col("n_bytes"))),
        ]
    )
    facts.join(owner, "digest").select("page_id", "digest", header.alias("header")).write.parquet(f"{folder}/headers")
    # One copy of each payload: the owner's. Owners with the same id and payload are dropped by the aggregate.
    # Ids are compared as number and flag, so that the join and the aggregate deal payloads out by the same keys, once.
    number = lambda c: [F.coalesce(c, F.lit(0)).alias("_id"), F.col(c).isNull().alias("_none")]
    own = owner.select("digest", *number("owner"))
    kept = keyed.select("digest", *number("page_id"), "payload").join(own, ["digest", "_id", "_none"], "left_semi")
    kept.dropDuplicates(["digest", "_id", "_none"]).select("digest", "payload").write.parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, target, payload_bytes, payload_digest, verified, digest, header).

    The payload figures are computed from the stored bytes; ``verified`` says that these bytes have the digest
    under which they are stored and the SHA-1 that the header states.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    stored = stored.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("digest")).alias("same"))
    headers = spark.read.schema("page_id long, digest string, header string").parquet(f"{folder}/headers")
    field = lambda name: header_field(F.col("header"), name)
    return headers.join(stored, "digest", "left").select(
        F.regexp_extract(field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("target"),
        "payload_bytes",
        "payload_digest",
        F.coalesce(F.col("same") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit(False)).alias("verified"),
        "digest",
        "header",
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the exact bytes of each record, the payload joined back in for responses; a payload that is not
    what was stored is an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload is not the one stored as "), F.col("digest")))
    stored = stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))
    headers = spark.read.schema("page_id long, digest string, header string").parquet(f"{folder}/headers")
    full = headers.where(header_field(F.col("header"), "WARC-Type") == "response").join(stored, "digest").select("page_id", "header", "payload")
    short = headers.where(header_field(F.col("header"), "WARC-Type") == "revisit").select("page_id", "header", F.lit(b"").alias("payload"))
    end = F.encode(F.lit(END + END), "UTF-8")
    return full.unionByName(short).select("page_id", F.concat(F.encode("header", "UTF-8"), "payload", end).alias("record"))


def op8_warc(pages: DataFrame) -> DataFrame:
    folder = archive_folder(pages.sparkSession)
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def oracle() -> str:
    """DuckDB SQL for :func:`op8_warc`."""
    letter = lambda k, shift: f"substring('{BASE32}', ((CAST('0x' || substring(h, {5 * k + 1}, 5) AS INT) >> {shift}) & 31) + 1, 1)"
    digest = " || ".join(letter(k, shift) for k in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {digest} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to, true AS verified FROM p"""
