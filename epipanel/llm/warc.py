"""Legacy ARC archives to WARC, with revisit records for equal payloads."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .support import text_of

ARCHIVE_BYTES = 8_000_000    # payload bytes of one archive file, about
LEAST_REVISIT = 1_000        # smaller payloads are never revisits
STAMP = "20000101000000"
# The columns of a record's header line, by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
RECORDS = (
    "page_id long, url string, warc_date string, content_type string, payload_bytes long, payload_digest string, "
    "content_key binary, record_id string, head binary, body binary"
)
READ = (
    "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "record_id string, url string, warc_date string, body binary"
)


# ------------------------------------------------------------------ ARC

def arc_url(url: str | None) -> str:
    """A URL without the blanks that part the fields of a header line."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:none"


def arc_header(version: str, name: str) -> bytes:
    block = f"{version} 0 archive\n{' '.join(LABELS[f] for f in ARC_FIELDS[version])}\n\n".encode()
    values = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": STAMP, "type": "text/plain", "status": "200",
              "checksum": "-", "location": "-", "offset": "0", "file": name, "length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


LABELS = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code",
          "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}


def arc_record(version: str, page_id: int | None, url: str | None, payload: bytes, name: str) -> bytes:
    """A record with an HTTP response whose header carries the page's id."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        http.append(f"X-Page-Id: {page_id}")
    if url is not None:
        http.append(f"X-Url: {base64.b64encode(url.encode()).decode()}")
    block = "\r\n".join([*http, "", ""]).encode() + payload
    values = {"url": arc_url(url), "ip": "0.0.0.0", "date": STAMP, "type": "text/html", "status": "200", "checksum": "-",
              "location": "-", "offset": "0", "file": name, "length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record after the archive's own header.

    The first record names the version, which fixes the fields of the header
    lines. Every block is as long as its line declares, whatever it holds.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            break
        line = data[at:end].decode("utf-8", "replace").strip("\r")
        at = end + 1
        if not line:
            continue
        values = line.split(" ")
        block = data[at : at + int(values[-1])]
        if len(block) < int(values[-1]):
            raise ValueError("an ARC record ends before its declared length")
        at += len(block)
        if fields is None:
            fields = ARC_FIELDS[block.split(b" ", 1)[0].decode()]
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields instead of {len(fields)}")
        yield dict(zip(fields, values)), block


def arc_archives(pages: DataFrame, version: str = "1", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): the pages as ARC archives, as ``binaryFile`` reads them.

    Each task packs its pages, in order, into archives of about ``archive_bytes``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size, records = TaskContext.get().partitionId(), 0, 0, []

        def packed() -> pa.RecordBatch:
            content = b"".join([arc_header(version, name), *records])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page_id, url, html in zip(*batch.columns):
                name = f"part-{part:06d}-{k:05d}.arc"
                records.append(arc_record(version, page_id.as_py(), url.as_py(), html.as_py().encode(), name))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield packed()
                    k, size, records = k + 1, 0, []
        if records:
            yield packed()

    return pages.select("page_id", "url", "html").mapInArrow(pack, "path string, content binary")


# ------------------------------------------------------------- conversion

def warc_date(stamp: str) -> str:
    return datetime.datetime.strptime(stamp[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header bytes, header fields and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + b"\r\n\r\n", {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, payload


def convert(archives: DataFrame) -> DataFrame:
    """WARC records of ARC archives: identifiers, dates, types and digests.

    ``archives`` has ``content``, as the ``binaryFile`` source gives it; gzip
    is recognised. The identifier follows from the record's fields and payload,
    so a repeated task makes the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_arc(inflate(content.as_py())):
                    head, http, payload = http_parts(block)
                    page = http.get("x-page-id")
                    url = base64.b64decode(http["x-url"]).decode() if "x-url" in http else None
                    sha1 = hashlib.sha1(payload)
                    key = hashlib.sha256(payload).digest()
                    name = uuid.UUID(
                        bytes=hashlib.sha256(f"{fields['url']} {fields['date']} {page} ".encode() + key).digest()[:16], version=4
                    )
                    rows.append((None if page is None else int(page), url, warc_date(fields["date"]), fields["type"], len(payload),
                                 sha1.hexdigest(), key, f"<urn:uuid:{name}>", head, payload))
                if rows:
                    yield from in_batches(rows, RECORDS)

    return archives.select("content").mapInArrow(run, RECORDS)


def inflate(content: bytes) -> bytes:
    """Contents of a gzip file of one or more members; other bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def in_batches(rows: list[tuple], schema: str, size: int = 500) -> Iterator[pa.RecordBatch]:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    for start in range(0, len(rows), size):
        columns = zip(*rows[start : start + size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
        )


def with_types(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds record_type, refers_to and refers_to_record.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest page id is the response; a null id is below all others, and rows
    that repeat the largest are responses too. Only digests are grouped, and a
    frequent payload is merged in each task first.
    """
    large = F.col("payload_bytes") >= least
    top = (
        records.where(large).groupBy("content_key")
        .agg(F.max(F.struct("page_id", "record_id")).alias("top"))
        .select(F.col("content_key").alias("_key"), "top")
    )
    # Small payloads match nothing; their own keys spread equal ones.
    key = F.when(large, F.col("content_key")).otherwise(F.unhex(F.md5("record_id")))
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    return (
        records.join(top, key == F.col("_key"), "left")
        .withColumns(
            {
                "record_type": F.when(revisit, "revisit").otherwise("response"),
                "refers_to": F.when(revisit, F.col("top.page_id")),
                "refers_to_record": F.when(revisit, F.col("top.record_id")),
            }
        ).drop("_key", "top")
    )


# ------------------------------------------------------------------- WARC

def write_warc(records: DataFrame, path: str, records_per_file: int) -> None:
    """Write typed records as gzipped WARC files.

    A revisit keeps the HTTP header, which tells the payload's length, and the
    digest, but no payload. A task starts a new file after so many records, so
    that a file can be read whole. The text writer passes bytes through as they are; it ends each
    record with the two line ends that the format asks for.
    """
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "body"))

    def line(name: str, value) -> object:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.col("refers_to_record")),
                F.coalesce(line("X-Refers-To-Page", F.col("refers_to").cast("string")), F.lit("")),
                line("WARC-Truncated", F.lit("length")),
            ),
        ).otherwise(""),
        line("Content-Length", F.length("block").cast("string")),
        F.lit("\r\n"),
    )
    (
        records.withColumn("block", block)
        .select(F.concat(header.cast("binary"), F.col("block")).cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a WARC header does not end")
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a WARC record ends before its declared length")
        yield fields, block
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str, *, bodies: bool = True) -> DataFrame:
    """The records of WARC files, payloads of responses included on request.

    A response's payload must match its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(inflate(content.as_py())):
                    _, http, payload = http_parts(block)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    page, refers = http.get("x-page-id"), fields.get("x-refers-to-page")
                    url = base64.b64decode(http["x-url"]).decode() if "x-url" in http else None
                    rows.append((None if page is None else int(page), kind, size, digest, None if refers is None else int(refers),
                                 fields["warc-record-id"], url, fields["warc-date"], payload if bodies and kind == "response" else None))
                if rows:
                    yield from in_batches(rows, READ)

    found = spark.read.format("binaryFile").load(path).select("content")
    return found.mapInArrow(run, READ)


def archive(pages: DataFrame, path: str | None = None, version: str = "1", *, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Pack pages as ARC, convert them, and write WARC files; returns their folder.

    ``pages`` has page_id, url and html; null html is an empty payload, null ids
    and URLs are left out of the records and read back as null. Every row gets
    a record, repeated rows too. An empty table makes a folder without records.
    Other columns, whatever their names, are not read. Files hold about
    ``archive_bytes`` of payload, so that one is read whole by a task; the
    folder is a new one in the shared folder if none is named.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    each = max(1, n * archive_bytes // max(1, total))
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_types(convert(arc_archives(rows, version, archive_bytes))), path, each)
    return path
