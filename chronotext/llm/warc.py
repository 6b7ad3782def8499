"""WARC archives whose repeated payloads are revisit records.

Headers (no payloads) are shuffled by payload digest to find each digest's original; payloads move once, to their file.
Records are written by Spark's text writer with the record separator as its line end, so a file is a plain sequence of
WARC records on whatever store Spark writes to. Reading parses by Content-Length and joins revisits to originals.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.llm.common import arrow_map

#: Fixed values of the WARC 1.1 format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 16 << 20


def headers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, payload_bytes, payload_digest (bare lower-case hex SHA-1); null html is an empty payload."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col(key), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def resolve(heads: DataFrame, least: int = 1000, key: str = "page_id") -> DataFrame:
    """Per distinct header: key, payload_digest, payload_bytes, refers_to.

    Of equal payloads of at least ``least`` bytes the largest key is the original; the others refer to it. Only digests
    that occur under different keys take part in the join.
    """
    found = heads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(key).alias("_last"), F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"), F.count(key).alias("_keys"))
    originals = found.filter((F.col("_first") != F.col("_last")) | (F.col("_keys").between(1, F.col("_n") - 1))).select("payload_digest", F.col("_last").alias("refers_to"))
    joined = heads.distinct().join(originals, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("refers_to")), F.col("refers_to")))


def record_id(key: Column, digest: Column) -> Column:
    """A name that a repeated task makes again."""
    h = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), digest))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 1000, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record for each row of ``pages``; ``path`` must not exist yet.

    Rows of equal key and payload are the same capture and get the same kind of record. Control characters in a url are
    dropped from its header; a null url has none. Files hold about FILE_BYTES before gzip, as rows are dealt by key and
    payload.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = pages.select(F.col(key), F.regexp_replace(url, r"\p{Cntrl}", "").alias("_url"), payload.alias("_payload"), F.sha1(payload.cast("binary")).alias("_digest"), name.alias("_name"))
    heads = headers(pages, key, html)
    decided = resolve(heads, least, key).select(name.alias("_name"), F.col("payload_digest").alias("_digest"), "refers_to")
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(1, math.ceil(total / FILE_BYTES))
    # Both sides are dealt alike, so the join moves payloads no second time and a task's rows are a file.
    at = ["_name", "_digest"]
    joined = rows.repartition(files, *at).join(decided.repartition(files, *at), at, "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("_payload"), F.lit(CRLF + CRLF))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col(key), F.col("_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("_url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("_digest")))),
        F.concat(F.lit("X-Page-ID: "), F.col(key).cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)
    joined.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("refers_to_id", T.StringType()), T.StructField("header_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def parse_records(content: bytes) -> Iterator[tuple]:
    """Records of one archive file, as RECORD; the payload is what follows the HTTP header (null for revisits)."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        named = dict(line.split(": ", 1) for line in content[at:head].decode("utf-8").split(CRLF)[1:])
        start, size = head + 4, int(named["Content-Length"])
        block = content[start : start + size]
        at = start + size + 4
        kind, page = named["WARC-Type"], named.get("X-Page-ID")
        payload = None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]
        yield (named["WARC-Record-ID"], kind, named.get("WARC-Target-URI"), None if page is None else int(page), named.get("WARC-Refers-To"), named["WARC-Payload-Digest"].removeprefix("sha1:"), payload)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in ``path``, one file to a task's step; see RECORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse_records(gzip.decompress(content.as_py())):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=RECORD.names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=RECORD.names)

    return arrow_map(spark.read.format("binaryFile").load(path).select("content"), run, RECORD)


ARROW = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; revisits get their original's.

    Digest and size come from the payload that was read; a revisit takes them over the join with its original response.
    """
    slim = records.select("record_id", "record_type", "page_id", "refers_to_id", F.octet_length("payload").cast("long").alias("_bytes"), F.sha1("payload").alias("_digest"))
    responses = slim.filter("record_type = 'response'")
    first = responses.groupBy("record_id").agg(F.first("page_id").alias("_page"), F.first("_bytes").alias("_b"), F.first("_digest").alias("_d"))
    revisits = slim.filter("record_type = 'revisit'").drop("_bytes", "_digest", "record_id").join(first, F.col("refers_to_id") == F.col("record_id"), "left")
    return responses.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("_b").alias("payload_bytes"), F.col("_d").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    )
