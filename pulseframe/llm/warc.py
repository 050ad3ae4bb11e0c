"""WARC archives with revisit records.

Only headers (key, digest, size) are shuffled to find equal payloads: the largest key
per digest becomes the response, the others revisits that refer to it.  Payloads move
once, to be written.  Records are written by Spark's text sink, whose record separator
is the blank line pair that ends every WARC record, as gzip files.

Defined results: a null payload is empty; among equal payloads the largest key answers,
null keys counting as the smallest; of rows that repeat a key and its payload one is the
response and the others are revisits of it; payloads below ``min_bytes`` are all
responses; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import mapped_batches, table, written
from pulseframe.session import scratch_path

CRLF = "\r\n"
# Fixed values of the format.
RECORD_END = CRLF * 2
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Bounds the size of one archive file, which a reader opens as a whole.
RECORDS_PER_FILE = 5000


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each ten hex digits are eight base32 digits."""
    hex_digits = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(hex_digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as ``page_id, url, payload`` with a payload of bytes."""
    payload = pages[payload_col].cast("string").cast("binary")
    return pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(payload, F.lit("").cast("binary")).alias("payload"),
    )


def resolve(recs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records with ``digest``, ``copy`` (1 for the first of equal rows), ``shared`` and ``latest``.

    ``shared`` tells that another record has the payload, ``latest`` is the key that answers for it.
    """
    heads = recs.select("page_id", payload_digest("payload").alias("digest"), F.octet_length("payload").alias("size"))
    heads = written(heads, "heads")
    groups = heads.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("of")).agg(
        F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")
    )
    groups = written(groups.where("n > 1").drop("n"), "groups")
    shared = heads.join(groups, heads["digest"] == groups["of"])
    shared = shared.select(F.col("page_id").alias("k"), F.col("digest").alias("of"), "latest").distinct()
    shared = written(shared, "shared")
    whole = recs.withColumn("digest", payload_digest("payload"))
    same = Window.partitionBy("page_id", "digest").orderBy("url")
    return (
        whole.join(shared, whole["page_id"].eqNullSafe(shared["k"]) & (whole["digest"] == shared["of"]), "left")
        .withColumn("copy", F.row_number().over(same))
        .withColumn("shared", F.col("of").isNotNull())
        .select("page_id", "url", "payload", "digest", "latest", "shared", "copy")
    )


def _record_id(key: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), copy.cast("string"), F.lit(">"))


def record_text(date: str) -> Column:
    """A whole WARC record, without the separator that ends it."""
    first = F.col("page_id").eqNullSafe(F.col("latest")) & (F.col("copy") == 1)
    response = ~F.col("shared") | first
    size = F.octet_length("payload")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        size.cast("string"),
        F.lit(CRLF * 2),
    )
    lines = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(response, "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _record_id(F.col("page_id"), F.col("copy")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        # A line break in a URI would end the header.
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]+", "%20"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(response, "").otherwise(
            F.concat(
                F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "),
                _record_id(F.col("latest"), F.lit(1)),
            )
        ),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.when(response, size).otherwise(0)).cast("string"),
        F.lit(CRLF * 2),
        http,
    )
    return F.concat(lines, F.when(response, F.col("payload").cast("string")).otherwise(""))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records as gzip archives below ``path``."""
    resolved.select(record_text(date).alias("value")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of every record, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = dict(_headers(stream))
        block = io.BytesIO(stream.read(int(headers["content-length"])))
        block.readline()
        http = dict(_headers(block))
        yield headers, http, block.read()


def _headers(stream: io.BufferedIOBase) -> Iterator[tuple[str, str]]:
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        yield name.lower(), value.strip()


def _key(urn: str | None) -> int | None:
    part = urn.split(":")[2] if urn else ""
    return int(part) if part else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: key, URL, type, size and digest of the full payload, and what it refers to.

    ``intact`` is true if a response's payload has the digest and the size its headers give.
    """

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                out: dict[str, list] = {n: [] for n in names}
                for headers, http, payload in _parsed(gzip.open(io.BytesIO(content))):
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    full = headers["warc-type"] == "response"
                    same = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == size
                    row = (
                        _key(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], size,
                        digest, _key(headers.get("warc-refers-to")), same if full else None,
                    )
                    for name, value in zip(names, row):
                        out[name].append(value)
                yield out

    schema = (
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, intact boolean"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return mapped_batches(files, schema, parse)


def revisit_archives(spark: SparkSession, recs: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``recs`` as de-duplicated archives below ``path`` and read them back."""
    write_archives(resolve(recs, min_bytes), path)
    return read_archives(spark, path)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = records(table(spark, sf_dir, "pages"))
    read = revisit_archives(spark, recs, scratch_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes,
         list_reduce(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           ((('0x' || h[CAST(floor(k * 5 / 4) AS BIGINT) + 1])::INT * 16
             + coalesce(('0x' || nullif(h[CAST(floor(k * 5 / 4) AS BIGINT) + 2], ''))::INT, 0))
            // [8, 4, 2, 1][k % 4 + 1]) % 32 + 1]), lambda a, b: a || b) AS payload_digest
  FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to,
       CASE WHEN page_id = latest THEN true END AS intact
FROM g
"""
