"""Content-addressed web archive.

An archive is two tables: `payloads` holds each distinct payload once under its SHA-256, `headers` holds one row per
record with the exact WARC and HTTP header bytes and the digest. Records are put together again through a join.

Defined results: null html is an empty payload; null url is an empty target; an empty table gives an empty archive;
repeated rows give repeated records over one payload; of records with one payload the one with the largest page_id
is the response (all of them where that id repeats), and rows without page_id revisit it (they are the response if no
row of that payload has an id). Only page_id, url and html are read, so extra columns never clash.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, salted_lookup, scratch_path

_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("sha1", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
_PAGE_SQL = "page_id long, url string, digest binary, sha1 string, n_bytes long, payload binary"
_INDEX_SQL = "digest binary, sha1 string, n_bytes long, holder long"


def _digested(batches):
    for b in batches:
        payload = [(x or "").encode("utf-8") for x in b.column("html").to_pylist()]
        yield pa.record_batch(
            [
                b.column("page_id"),
                b.column("url"),
                pa.array([hashlib.sha256(x).digest() for x in payload], pa.binary()),
                pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payload], pa.string()),
                pa.array([len(x) for x in payload], pa.int64()),
                pa.array(payload, pa.binary()),
            ],
            schema=_PAGE,
        )


def _verified(batches):
    """Index rows of stored payloads; the digest is computed again from the bytes that were read."""
    for b in batches:
        payload, digest = b.column("payload").to_pylist(), b.column("digest").to_pylist()
        for p, d in zip(payload, digest):
            if hashlib.sha256(p).digest() != d:
                raise ValueError(f"payload under {d.hex()} has another digest")
        yield pa.record_batch(
            [
                b.column("digest"),
                pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payload], pa.string()),
                pa.array([len(x) for x in payload], pa.int64()),
                b.column("holder"),
            ],
            names=["digest", "sha1", "n_bytes", "holder"],
        )


def write_archive(pages: DataFrame, path: str) -> None:
    """Write `path`/payloads and `path`/headers.

    Payload bytes are shuffled once, after equal ones met within each task. What then travels per record is digests
    and ids; the join to the digest's holder is salted, so one payload with a third of all records is spread."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(_digested, _PAGE_SQL)
    stored = rows.groupBy("digest").agg(F.max("page_id").alias("holder"), F.any_value("payload").alias("payload"))
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    holders = rows.sparkSession.read.parquet(f"{path}/payloads").select("digest", "holder")
    found = salted_lookup(rows.select("page_id", "url", "digest", "sha1", "n_bytes"), holders, "digest", "page_id")
    is_response = F.col("page_id").eqNullSafe(F.col("holder"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.when(is_response, F.octet_length(http) + F.col("n_bytes")).otherwise(F.octet_length(http))
    warc = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(is_response, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.when(is_response, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("holder")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
    )
    found.select("page_id", "digest", F.encode(warc, "UTF-8").alias("warc_header"), F.encode(http, "UTF-8").alias("http_header"), is_response.alias("response")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def payload_index(spark: SparkSession, path: str) -> DataFrame:
    """digest, sha1, n_bytes, holder of every stored payload, from its bytes."""
    return spark.read.parquet(f"{path}/payloads").select("digest", "holder", "payload").mapInArrow(_verified, _INDEX_SQL)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Each record's fields, parsed from its stored header bytes and checked against its payload."""
    headers = spark.read.parquet(f"{path}/headers")
    text = F.decode("warc_header", "UTF-8")
    field = lambda name: F.regexp_extract(text, f"\r\n{name}: ([^\r\n]*)", 1)
    parsed = headers.select(
        "digest",
        F.regexp_extract(field("WARC-Record-ID"), "<urn:page:(-?[0-9]+)>", 1).alias("_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).alias("_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("_claimed"),
    )
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    index = materialise(payload_index(spark, path), "warc-index").drop("holder")
    joined = salted_lookup(parsed, index, "digest", "_id", how="inner")
    checked = F.when(F.col("_claimed") == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("payload digest differs from its header")))
    return joined.select(number("_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", number("_to").alias("refers_to"), "url")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the full bytes of each original record, payload included (a revisit ends after its HTTP header, so only
    responses meet payload bytes)."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    whole = headers.where("response").join(payloads.select("digest", "payload"), "digest")
    record = lambda body: F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n")).alias("record")
    return whole.select("page_id", record(F.col("payload"))).union(headers.where("not response").select("page_id", record(F.lit(b""))))


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to a new archive in the shared folder, read it back, return its records."""
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return read_records(spark, path)
