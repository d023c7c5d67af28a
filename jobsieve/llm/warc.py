"""WARC archives: writing captures, reading records, and putting transactions together.

A capture is three records: the request, the response or a revisit of an equal payload, and
metadata. Request and metadata name the response through WARC-Concurrent-To. Reading gives one row
per record; the records of a capture are joined through that identifier into one nested row.

Files are gzip-compressed WARC 1.1, written and committed by Spark's text writer, so they can go to
any store Spark writes to, and a lost task writes its files again.
"""

from __future__ import annotations

import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.once import computed
from ..session import cut, shared_folder

#: Uncompressed bytes of one archive file.
FILE_BYTES = 32 << 20
#: The date of records whose capture time is not given.
CAPTURED_AT = "2024-01-01T00:00:00Z"
#: Payloads of at least this many bytes are revisited if equal.
REVISIT_BYTES = 0
_LINE = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Base-32 SHA-1: ten hexadecimal digits are eight digits to base 32, in another alphabet."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _safe(value: Column) -> Column:
    """Control characters would end a header line; they are written as a percent code."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def _record(kind: str | Column, fields: list[tuple[str, Column]], media: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(f"\r\nWARC-Date: {CAPTURED_AT}\r\n"))]
    head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_LINE)), F.lit("")) for name, value in fields]
    size = F.octet_length(block).cast("string")
    return F.concat(*head, F.lit(f"Content-Type: {media}\r\nContent-Length: "), size, F.lit(_LINE * 2), block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write a capture per row of ``pages`` below ``path``.

    A null payload is empty. Of rows with equal payloads that with the largest page_id is the
    response, the others are revisits of it; rows that share the largest page_id are all responses,
    and rows with a null page_id are revisits if any page_id is known. A null url is left out.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("body"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("body").cast("binary")), "bytes": F.octet_length("body")})
    groups = cut(rows.groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")))
    mean = groups.agg((F.sum(F.col("n") * (F.col("bytes") + 1500)) / F.sum("n")).alias("m")).first().m or FILE_BYTES
    again = groups.where((F.col("n") > 1) & (F.col("bytes") >= REVISIT_BYTES)).select("digest", "first")
    rows = rows.join(again, "digest", "left")
    rows = computed(rows, capture=F.expr("uuid()"), revisit=F.coalesce(F.col("first") != F.coalesce("id", F.lit(None)), F.col("first").isNotNull()))

    name = lambda kind: F.concat(F.lit(f"<urn:uuid:{kind}-"), F.col("capture"), F.lit(">"))
    target = ("WARC-Target-URI", _safe(F.col("url")))
    together = ("WARC-Concurrent-To", name("capture"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(_LINE * 2),
    )
    host = F.regexp_extract(_safe(F.col("url")), r"^[A-Za-z]+://([^/?#]*)", 1)
    request = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(_LINE * 2))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(_LINE)), F.lit("")), F.lit("via: page table\r\n"))
    answer = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", name("capture")), target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        ],
        "application/http;msgtype=response",
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("body"))),
    )
    records = [
        _record("request", [("WARC-Record-ID", name("request")), target, together], "application/http;msgtype=request", request),
        answer,
        _record("metadata", [("WARC-Record-ID", name("metadata")), together], "application/warc-fields", about),
    ]
    out = rows.select(F.concat_ws(_LINE * 2, *records).alias("value"))
    per_file = max(1, int(FILE_BYTES / mean))
    out.write.option("compression", "gzip").option("lineSep", _LINE * 2).option("maxRecordsPerFile", per_file).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record. The stated length, not the content, ends a block."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def unpacked(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


_RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to string, stated_digest string, "
    "page_id bigint, payload_bytes bigint, payload_digest string, payload binary"
)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record below ``path``. The digest of a response is taken of the payload that was read.

    A revisit has no payload: its size and digest are those its headers state. A record that ends
    early or has no length raises an error and is never left out.
    """

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in parse(unpacked(content)):
            kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            size = sha = body = page = None
            if kind in ("response", "revisit"):
                head, _, body = block.partition(b"\r\n\r\n")
                size, sha = len(body), b32encode(sha1(body).digest()).decode()
                if kind == "revisit":
                    sha, body = digest, None
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            elif kind == "metadata":
                stated = [x.split(b":")[1] for x in block.split(b"\r\n") if x.startswith(b"page-id:")]
                page = int(stated[0]) if stated else None
            yield (
                fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"),
                fields.get("warc-refers-to"), digest, page, size, sha, body if with_payload else None,
            )

    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                got = list(rows(content.as_py()))
                columns = [pa.array(c, k) for c, k in zip(zip(*got), kinds)]
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: the response's columns, with ``request`` and ``metadata`` nested in it."""
    answer = records.where("type IN ('response', 'revisit')").drop("concurrent_to", "page_id")
    request = records.where("type = 'request'").select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), "target_uri").alias("request")
    )
    about = records.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), "page_id").alias("metadata")
    )
    return answer.join(request, "record_id", "left").join(about, "record_id", "left")


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and put the captures together."""
    spark = pages.sparkSession
    path = write_archives(pages, f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}", page_id, url, html)
    return captures(cut(read_records(spark, path, with_payload)))
