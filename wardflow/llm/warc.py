"""WARC transactions: write captures as request, response and metadata records, and join them back.

Writing is one projection into Spark's text sink (a record is header, block and
the separator the sink adds), gzip-compressed, with as many rows a file as keep
a file's content under ``MAX_FILE_BYTES``; pages far above the usual size get files
of their own, so they do not decide on the files of all others.  Reading streams
through an archive record by record (the compressed file is held, one unpacked
record and a batch of some MB; a file of over 2 GB cannot be read) and joins the
records of a capture through all its ``WARC-Concurrent-To`` links: a response or
revisit anchors its capture, other records reach it by a link either way, or over
any number of other records, by the components of the links.

Defined cases: a null payload is empty; equal payloads share one response, the
row with the smallest page id (unknown ids last, then the first stored row), and
the others revisit it, so repeated rows do too; payloads shorter than
``min_revisit_bytes`` are always responses; line breaks in a url are
percent-encoded; a record without an anchor makes a capture without response;
an empty table gives an empty archive; columns other than the named ones are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.session import new_folder, write_table

from .components import connected_components

MAX_FILE_BYTES = 64 << 20
MAX_FILE_ROWS = 4000
#: A page above this size gets a file of its own.
OUTSIZED_BYTES = MAX_FILE_BYTES // 64
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINCIPAL = ("response", "revisit", "resource")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without the separator after it; fields with a null value are left out."""
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_captures(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one request, one response or revisit, and one metadata record a row to the archive folder ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = write_table(pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("body"),
        base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"),
        F.monotonically_increasing_id().alias("serial"),
    ))
    origin = rows.where(f"n >= {min_revisit_bytes}").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "serial")).alias("first"),
        F.first("n").alias("size"), F.min_by("url", F.struct(F.col("id").isNull(), "id", "serial")).alias("origin_url"))
    origin = write_table(origin.select(
        "digest", "size", "origin_url", F.col("first.id").alias("origin_id"), F.col("first.serial").alias("origin")))
    sizes = rows.agg(F.max("n").alias("all"), F.max(F.when(F.col("n") <= OUTSIZED_BYTES, F.col("n"))).alias("usual")).first()
    usual = sizes["usual"] or 0
    per_file = max(1, min(MAX_FILE_ROWS, MAX_FILE_BYTES // (usual + 2048)))

    def name(kind: str, page: str = "id", serial: str = "serial") -> Column:
        return F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"),
                        F.col(serial).cast("string"), F.lit(f":{kind}>"))

    rows = rows.join(origin.drop("size"), "digest", "left")
    revisit = F.col("origin").isNotNull() & (F.col("origin") != F.col("serial"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "\r", "%0D"), "\n", "%0A")
    url, day = clean("url"), F.lit(date)
    host = F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    target = F.when(target == "", "/").otherwise(target)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    only = lambda c: F.when(revisit, c)
    main = _record([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", name("response")),
        ("WARC-Date", day), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", only(F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", only(name("response", "origin_id", "origin"))),
        ("WARC-Refers-To-Target-URI", only(clean("origin_url"))), ("WARC-Refers-To-Date", only(day)),
    ], F.concat(http, F.when(revisit, "").otherwise(F.col("body"))))
    request = _record([
        ("WARC-Type", "request"), ("WARC-Record-ID", name("request")), ("WARC-Date", day), ("WARC-Target-URI", url),
        ("WARC-Concurrent-To", name("response")), ("Content-Type", "application/http;msgtype=request"),
    ], F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    metadata = _record([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), ("WARC-Date", day), ("WARC-Target-URI", url),
        ("WARC-Concurrent-To", name("response")), ("Content-Type", "application/warc-fields"),
    ], F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")))
    parts = [(rows.where(F.col("n") <= usual), per_file)]
    if (sizes["all"] or 0) > usual:
        parts.append((rows.where(F.col("n") > usual), 1))
    for part, limit in parts:
        part.select(F.concat_ws("\r\n\r\n", request, main, metadata).alias("value")).write.mode("append").option(
            "compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", limit).text(path)


def _fields(head: bytes) -> dict[str, str]:
    """Lower-cased header fields; of repeated ones the first, but all values of ``warc-concurrent-to``, by a blank."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, sep, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if sep and key == "warc-concurrent-to" and key in out:
            out[key] += f" {value}"
        elif sep:
            out.setdefault(key, value)
    return out


class Unzipped(io.RawIOBase):
    """The content of gzip members that follow each other, unpacked as it is read; a cut-off end ends it."""

    def __init__(self, data: bytes) -> None:
        self.packed, self.at, self.member, self.held = memoryview(data), 0, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.held and self.at < len(self.packed):
            if self.member is None:
                if self.packed[self.at:self.at + 2] != b"\x1f\x8b":
                    return 0
                self.member = zlib.decompressobj(31)
            part = self.packed[self.at:self.at + (1 << 16)]
            self.held = self.member.decompress(part)
            self.at += len(part) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
        n = min(len(target), len(self.held))
        target[:n], self.held = self.held[:n], self.held[n:]
        return n


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased header fields, block) of each record of one archive, compressed or not, one at a time."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(Unzipped(data), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        if not line:
            return
        fields = _fields(b"".join(head))
        yield fields, stream.read(int(fields.get("content-length") or 0))


_RECORD = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
           "record_date string, payload binary, payload_bytes long, payload_digest string, warc_fields string")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.binary() if "binary" in x else pa.int64() if "long" in x else pa.string() for x in _RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        for content in b.column(0):
            rows, held = [], 0
            for f, block in parse_records(content.as_py()):
                kind = f.get("warc-type", "")
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                payload, size, text = block, len(block), None
                if "application/http" in f.get("content-type", ""):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = len(payload)
                    if kind == "request":
                        payload = block
                    if kind == "revisit":
                        size = int(_fields(head).get("content-length") or 0)
                elif "warc-fields" in f.get("content-type", ""):
                    text = block.decode("utf-8", "replace")
                if kind in ("response", "resource"):
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"),
                             f.get("warc-target-uri"), f.get("warc-date"), payload, size, digest, text))
                held += len(payload)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archive files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parse, _RECORD)


def without_payloads(records: DataFrame) -> DataFrame:
    """The records written once with null payloads of responses; size and digest stay.

    For callers that do not return payloads: the archives are parsed once, and
    the capture join shuffles headers only.
    """
    return write_table(records.withColumn("payload", F.when(~F.col("record_type").isin(*PRINCIPAL), F.col("payload"))))


def _anchors(records: DataFrame, main: Column) -> DataFrame:
    """``(record_id, anchor)`` of the records that links join to a capture.

    Links to a response, or from one, decide directly.  Where none does, the
    links that are left are followed as a graph: its component's smallest
    response is the anchor, without one the smallest id that is no record, or
    the smallest record.
    """
    thin = write_table(records.where("record_id is not null").select(
        "record_id", F.coalesce(main, F.lit(False)).alias("principal"), "concurrent_to"))
    links = thin.select("record_id", "principal", F.explode(F.split("concurrent_to", " ")).alias("to"))
    captures = thin.where("principal").select("record_id").distinct()
    to_capture = links.where("not principal").join(captures.toDF("to"), "to").select("record_id", F.col("to").alias("anchor"))
    from_capture = links.where("principal").select(F.col("to").alias("record_id"), F.col("record_id").alias("anchor"))
    direct = write_table(to_capture.union(from_capture).groupBy("record_id").agg(F.min("anchor").alias("anchor")))
    left = write_table(links.where("not principal").join(direct, "record_id", "left_anti").select("record_id", "to"))
    if not left.head(1):
        return direct
    reached = direct.join(left.select(F.col("to").alias("record_id")).distinct(), "record_id", "left_semi")
    edges = left.union(reached.select("record_id", F.col("anchor").alias("to")))
    groups = connected_components(edges.select(F.xxhash64("record_id").alias("a"), F.xxhash64("to").alias("b")))
    names = edges.select("record_id").union(edges.select("to")).distinct()
    kind = thin.groupBy("record_id").agg(F.max("principal").alias("principal"))
    rank = F.when(F.col("principal"), 0).when(F.col("principal").isNull(), 1).otherwise(2)
    ranked = names.join(kind, "record_id", "left").withColumn("node", F.xxhash64("record_id")).join(groups, "node")
    best = write_table(ranked.groupBy("component").agg(F.min(F.struct(rank.alias("rank"), "record_id")).alias("best")))
    found = ranked.join(best, "component").select("record_id", F.col("best.record_id").alias("anchor"))
    return direct.union(found.join(left.select("record_id").distinct(), "record_id", "left_semi"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture_id``, ``response``, and the arrays ``requests`` and ``metadata``.

    ``response.record_id`` is null where no response, revisit or resource record
    was found.  Columns beside those of ``read_records`` are not read.
    """
    records = records.select(*[x.split()[0] for x in _RECORD.split(", ")])
    main = F.col("record_type").isin(*PRINCIPAL)
    others = records.where(~main | F.col("record_type").isNull())
    keyed = records.where(main).withColumn("anchor", F.col("record_id")).unionByName(
        others.join(_anchors(records, main), "record_id", "left").withColumn("anchor", F.coalesce("anchor", "record_id")))
    one = lambda c: F.first(F.when(main, F.col(c)), ignorenulls=True).alias(c)
    picked = ("record_id", "record_type", "refers_to", "target_uri", "record_date", "payload", "payload_bytes",
              "payload_digest")
    small = F.struct("record_id", "target_uri", "record_date", F.col("payload").cast("string").alias("block"))
    extra = F.struct("record_id", "record_type", "warc_fields")
    kind = F.col("record_type")
    out = keyed.groupBy("anchor").agg(
        *[one(c) for c in picked],
        F.sort_array(F.collect_list(F.when(kind == "request", small))).alias("requests"),
        F.sort_array(F.collect_list(F.when(~main & (kind != "request"), extra))).alias("metadata"),
    )
    return out.select(F.col("anchor").alias("capture_id"), F.struct(*picked).alias("response"), "requests", "metadata")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive in the shared checkpoint folder."""
    return new_folder(spark, "warc")
