"""Content-addressed web archive: payloads once under their SHA-256, headers exactly, records rebuilt by joins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.common import Columns, write_table

_END = b"\r\n\r\n"
RECORDS = "record_id string, header binary, payload binary"


def parse_warc(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, exact header block with its blank line, payload) of the records of a WARC file, plain or gzipped.

    The payload is what Content-Length announces. Bytes that are no record raise ValueError.
    """
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(rest) + d.flush())
            rest = d.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        stop = data.find(_END, at)
        if stop < 0:
            raise ValueError(f"the record at byte {at} has no end of header")
        header = data[at : stop + 4]
        size = next((int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if size is None or stop + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} has no right Content-Length")
        yield at, header, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if data[at : at + 4] != _END:
            raise ValueError(f"the record that ends at byte {at} isn't closed")
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, header, payload) of all records of the WARC files at path, files as tasks; ids are file#offset."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for offset, header, payload in parse_warc(content):
                    yield pa.RecordBatch.from_pylist([{"record_id": f"{name}#{offset}", "header": header, "payload": payload}], pa.schema([("record_id", pa.string()), ("header", pa.binary()), ("payload", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, RECORDS)


def page_header(record_id: Column, url: Column, payload: Column) -> Column:
    """The header block of a response record for a page."""
    crlf = F.lit("\r\n")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), crlf, crlf)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record_id, header, payload) for each page; a null url or html is an empty one."""
    t = Columns(pages)
    html = F.coalesce(t(html_col), F.lit(""))
    return t.df.select(t(id_col).alias("record_id"), F.encode(page_header(t(id_col), t(url_col), html), "utf-8").alias("header"), F.encode(html, "utf-8").alias("payload"))


def archive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of records (record_id, header, payload).

    payloads (digest, payload, payload_bytes): each different payload once, under the SHA-256 of its bytes. headers
    (record_id, header, digest): the exact header of every record, repeated ones too. A null payload has no digest and
    no entry, and comes back as null; a null header is kept as null. Rows under one digest must agree in length and in
    a second, independent hash, and the stored payload must have its digest again: otherwise reading the payloads
    fails, rather than return another record's bytes.
    """
    t = Columns(records)
    keyed = t.df.select(t("record_id").alias("record_id"), t("header").alias("header"), t("payload").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    headers = keyed.select("record_id", "header", "digest")
    second = F.xxhash64("payload")
    one = keyed.where("digest is not null").groupBy("digest").agg(F.first("payload").alias("payload"), F.min(F.octet_length("payload")).alias("least"), F.max(F.octet_length("payload")).alias("most"), F.min(second).alias("low"), F.max(second).alias("high"))
    sound = (F.col("least") == F.col("most")) & (F.col("low") == F.col("high")) & (F.sha2("payload", 256) == F.col("digest"))
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), F.col("digest"))).cast("binary"))
    return headers, one.select("digest", checked.alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record_id, digest, payload_bytes, record): each record's original bytes, header, payload and closing lines.

    A header whose payload is missing has a null record.
    """
    closing = F.lit(_END)
    return headers.join(payloads, "digest", "left").select("record_id", "digest", "payload_bytes", F.concat("header", "payload", closing).alias("record"))


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, digest, payload_bytes, record): every page through the archive and back.

    The payload table is written to the shared folder once and joined from there. Repeated pages give repeated
    records of one payload; an empty table gives no rows.
    """
    headers, payloads = archive(page_records(pages, id_col, url_col, html_col))
    stored = write_table(payloads, "warc-payloads")
    return reconstruct(headers, stored).select(F.col("record_id").alias(id_col), "digest", "payload_bytes", F.decode("record", "utf-8").alias("record"))


WARC_SQL = r"""
select page_id, sha256(coalesce(html, '')) digest, cast(strlen(coalesce(html, '')) as bigint) payload_bytes,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Length: ' || cast(strlen(coalesce(html, '')) as varchar) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) record
from pages
"""
