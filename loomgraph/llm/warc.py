"""WARC archives with revisit records.

Writing: headers (page, digest, size) are grouped by payload digest to find each payload's original; pages join the
originals of repeated payloads and become response or revisit records with fresh headers. Tasks join records to archives
of a bounded size, and Spark's text writer writes a file for each, with the two line ends that close the last record as
its separator, so a lost task is written anew by the commit protocol. Reading follows Content-Length, so a payload may
hold anything.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one

#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 1000
#: So many bytes of records go to an archive, or one record if it is larger; a reader's task holds one archive.
ARCHIVE_BYTES = 16_000_000
#: Up to so many repeated payloads are broadcast to the pages; more are joined by a shuffle of the pages.
MAX_BROADCAST_ORIGINALS = 500_000
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"
_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, archive string"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest of pages; null html is an empty payload."""
    payload = F.coalesce("html", F.lit(""))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return out.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest"))


def originals(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Of payloads that repeat: payload_digest and original, the largest page_id. Counts are combined before the shuffle."""
    groups = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    return groups.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")


def with_record_type(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payloads() of pages with record_type and refers_to.

    Rows that repeat the original's page_id are responses too, and so are pages without an id.
    """
    found = payloads(pages)
    repeated = materialize(originals(found.select("page_id", "payload_bytes", "payload_digest"), least_bytes), "originals")
    few = repeated.count() <= MAX_BROADCAST_ORIGINALS
    out = found.join(F.broadcast(repeated) if few else repeated, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != F.col("original"))
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return out.withColumn("refers_to", F.when(again, F.col("original"))).drop("original")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def record_text(date: str = DATE) -> Column:
    """A record without the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}"), _line("Content-Length", F.col("payload_bytes")), F.lit(_END))
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, "payload"))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(_END),
        block,
    )


def _archives(archive_bytes: int):
    """A function for mapInArrow: values, of the sizes given, joined to archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        joined = lambda: pa.record_batch([pa.array([(_END * 2).join(held)])], names=["value"])
        for batch in batches:
            for value, size in zip(one_by_one(batch.column(0)), one_by_one(batch.column(1)), strict=True):
                if held and total + size + 4 > archive_bytes:
                    yield joined()
                    held, total = [], 0
                held.append(value)
                total += size + 4
        if held:
            yield joined()

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, compression: str = "none") -> None:
    """Write a record for each row of pages (page_id, url, html; other columns are left out) to archives under path.

    Null html is an empty payload, and records of null ids or urls have the name none or no address. Rows that repeat a
    page_id are records each. No archive exceeds archive_bytes unless a single record does. An empty table leaves an
    empty folder.
    """
    records = with_record_type(of_texts(pages), least_bytes).select(record_text(date).alias("value"))
    records = records.select("value", F.octet_length("value").alias("size")).mapInArrow(_archives(archive_bytes), "value string")
    records.write.option("lineSep", _END * 2).option("compression", compression).option("maxRecordsPerFile", 1).text(path)


def _unpacked(content: bytes) -> bytes:
    """content, of any number of gzip members if it is gzip."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member has no end")
        content = member.unused_data
    if parts and content.strip(b"\0"):
        raise ValueError("something else follows a gzip member")
    return b"".join(parts) if parts else content


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or of gzip members."""
    content = _unpacked(content)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split(_END)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, content[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def _page(name: str | None) -> int | None:
    digits = (name or "")[1 + len(_ID) : -1]
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under path. A response's size and digest are taken from its payload, a revisit's from its headers.

    A record named none has a null page_id, one without an address a null url. Repeated records are rows each; a folder
    without archives gives an empty table; a record that doesn't hold the payload of its headers is an error.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(one_by_one(batch.column(0)), batch.column(1), strict=True):
                rows = []
                for head, block in parse_archive(content.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    fields = dict(x.split(": ", 1) for x in http.decode().split(_END)[1:])
                    size = int(fields["Content-Length"])
                    if kind == "response" and (size != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"{file}: {head['warc-record-id']} doesn't hold its payload")
                    rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), kind, size, digest, _page(head.get("warc-refers-to")), payload if with_payload and kind == "response" else None, file))
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parsed, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload of each revisit taken from the response it refers to; a missing one leaves null."""
    full = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("__payload"))
    full = full.join(records.select("refers_to").filter("refers_to IS NOT NULL").distinct(), "refers_to", "left_semi").dropDuplicates(["refers_to"])
    out = records.join(full, "refers_to", "left")
    return out.withColumn("payload", F.coalesce("payload", "__payload")).select(*records.columns)
