"""WARC archives with revisit resolution.

Headers alone (page_id, digest, length) are shuffled by payload digest; the record with the
largest page_id among equal payloads of at least MIN_BYTES is the response, and the others
revisit it. The resolved revisits, one small row each, then meet their pages by page_id, so
no payload is ever moved to the place of its digest; while they are few enough to be
broadcast no payload is moved at all. Records are composed as text and written by Spark's
own text writer, so tasks that are lost and run again leave no half archives.

Reading takes each archive file as one binary value and follows Content-Length, so a payload
may hold anything, WARC headers included. Revisits are then joined to their responses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, staged

MIN_BYTES = 1000
#: Records and bytes of one archive file, which a reading task holds whole. A larger record has a file for itself.
RECORDS_PER_FILE, FILE_BYTES = 1000, 128 << 20
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id bigint, url string, record_type string, refers_to bigint, record_digest string, record_bytes bigint"


def _field(name: str, value: Column) -> Column:
    """A header line; line breaks inside a value would end it, so they become spaces. Null: no line."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " "), F.lit("\r\n")))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers (page_id, payload_digest, payload_bytes) -> (digest, bytes, page_id of the response) of payloads that occur again.

    Only payloads of at least min_bytes. Counts and maxima are combined before the shuffle,
    so a payload that a third of the pages share costs one row a task.
    """
    return (
        headers.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("original_id"))
        .filter("copies > 1 AND original_id IS NOT NULL")
        .drop("copies")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2020-01-01T00:00:00Z") -> None:
    """One record per row of pages (page_id, url, html) below path, html in UTF-8 being the payload; null is empty.

    Rows that tie on the largest page_id of a payload are all responses, as are rows without
    a page_id. A null url leaves the target out. Other columns are unused.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    headed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"),
        F.sha1(html.cast("binary")).alias("payload_digest"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
    )
    slim = headed.drop("html", "url")
    found = slim.join(resolve_revisits(slim, min_bytes), ["payload_digest", "payload_bytes"]).filter("original_id > page_id")
    # Written first: the size is then known to the join.
    revisits = staged(found.select("page_id", "payload_digest", "original_id").distinct(), "revisits")
    joined = headed.join(revisits, ["page_id", "payload_digest"], "left")
    revisit = F.col("original_id").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    # A row without a page_id, or that repeats one, is a record of its own all the same.
    record_id = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.concat(F.lit("WARC-Record-ID: "), record_id, F.lit("\r\n")),
        _field("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {date}\r\n"),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("original_id").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END)),
        body,
    )
    # Records of like size share files, so that their number bounds a file's bytes: usual ones, and by doublings larger ones.
    usual, longest = FILE_BYTES // RECORDS_PER_FILE, headed.agg(F.max("payload_bytes")).first()[0] or 0
    least, most = -1, usual
    while least < longest or least < 0:
        some = joined.filter((F.col("payload_bytes") > least) & (F.col("payload_bytes") <= most))
        some.select(record.alias("value")).write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", max(1, FILE_BYTES // most)).text(path)
        least, most = most, most * 8


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """The headers and content of each record of an archive, by Content-Length."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        yield head, view[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page(value: bytes | None) -> int | None:
    return int(value.removeprefix(b"<urn:page:").removesuffix(b">")) if value and value.startswith(b"<urn:page:") else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_digest", pa.string()), ("record_bytes", pa.int64())])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, body in parse(content.as_py()):
                digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                kind = head[b"WARC-Type"].decode()
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"the payload of {head[b'WARC-Record-ID']!r} has another digest")
                url = head.get(b"WARC-Target-URI")
                rows.append((_page(head.get(b"WARC-Record-ID")), None if url is None else url.decode(), kind, _page(head.get(b"WARC-Refers-To")), digest, len(body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below path with revisits resolved: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    records = staged(files.mapInArrow(_records, _READ), "records")
    revisits = records.filter("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    originals = (
        records.filter("record_type = 'response'").join(wanted, "page_id", "left_semi").groupBy("page_id", "record_digest").agg(F.max("record_bytes").alias("full"))
        .withColumnRenamed("page_id", "_of")
    )
    resolved = revisits.join(originals, (F.col("refers_to") == F.col("_of")) & (revisits["record_digest"] == originals["record_digest"]), "left").select(
        "page_id", "url", F.col("full").alias("payload_bytes"), revisits["record_digest"].alias("payload_digest"), "record_type", "refers_to"
    )
    plain = records.filter("record_type = 'response'").select(
        "page_id", "url", F.col("record_bytes").alias("payload_bytes"), F.col("record_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return plain.unionByName(resolved)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as deduplicated archives and reads them back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original > page_id THEN original END AS refers_to
FROM o
"""
