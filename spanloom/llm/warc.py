"""Legacy ARC archives: a writer for tests and queries, a streaming parser, and the conversion to WARC.

ARC. A file opens with a version block, whose own header line names the version and whose text names the fields of
every header line; a record is a header line, the declared number of bytes, and a line feed. Version 1 lines have
five fields, version 2 lines ten. Files may be compressed record by record.

WARC. A record gets an id derived from its file and place, the ARC date as an ISO timestamp, a type by what it holds
(warcinfo for the version block, response for an HTTP message, resource for anything else, revisit for a payload that
another record has in full), and SHA-1 digests of block and payload in base 32. A revisit keeps the HTTP header and
names the response it refers to.

Conversion reads the archives twice and never shuffles a payload: the first reading yields digests, the second writes
each archive's records with the verdicts for them.

Defined cases: a null payload is empty; equal payloads shorter than ``min_bytes`` are all responses; of equal payloads
the record with the largest key is the response, of equal keys the last in file order, null keys below all others;
blanks in a URL are percent-encoded, a null URL is ``urn:null``, a header line may have any length; one that doesn't fit its version, or a
record shorter than declared, is an error; no archives give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, new_dir, table
from spanloom.llm.files import into_place, open_uri

#: The fields of ARC header lines, by version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: An HTTP header field that carries a record's key through both formats.
KEY_FIELD = "X-Record-Key"
#: A WARC field of revisits: the bytes of the payload that the record leaves out.
LENGTH_FIELD = "WARC-Payload-Length"
#: Bytes after which a new archive is begun, and the compression of its records.
ARCHIVE_BYTES = 64 << 20
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(value: str | None, empty: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) if value else empty


# ARC


def arc_line(version: int, fields: dict[str, str]) -> bytes:
    return " ".join(fields.get(f) or "-" for f in FIELDS[version]).encode("utf-8") + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    text = f"{version} 0 spanloom\n{' '.join(FIELDS[version])}\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Archive-length": str(len(text))}
    return arc_line(version, own) + text + b"\n"


def http_message(payload: bytes, key: object) -> bytes:
    field = "" if key is None else f"{KEY_FIELD}: {key}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{field}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _members(stream: BinaryIO) -> BinaryIO:
    """The stream, uncompressed if it is compressed."""
    magic = stream.read(2)
    stream.seek(0)
    return gzip.GzipFile(fileobj=stream) if magic == b"\x1f\x8b" else stream


def read_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record, the version block first."""
    data = _members(stream)
    names = FIELDS[1]
    first = True
    while True:
        line = data.readline()
        while line in (b"\n", b"\r\n"):
            line = data.readline()
        if not line:
            return
        if first and not line.startswith(b"filedesc://"):
            raise ValueError("an archive has to begin with its version block")
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if first:  # its line may be of either version; the block tells
            names = FIELDS[2] if len(values) == len(FIELDS[2]) else FIELDS[1]
        if len(values) != len(names):
            raise ValueError(f"a header line has {len(values)} fields, its version {len(names)}")
        head = dict(zip(names, values, strict=True))
        if not head["Archive-length"].isdigit():
            raise ValueError("a header line has no length")
        content = data.read(int(head["Archive-length"]))
        if len(content) != int(head["Archive-length"]):
            raise ValueError("a record is shorter than declared")
        if first:
            lines = content.decode("utf-8", "replace").splitlines()
            if len(lines) > 1 and lines[0][:1] in ("1", "2"):
                names = lines[1].split(" ")
            first = False
        yield head, content


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000", key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives of the rows, of either version by turns; (file, n_records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rows = ((k, u, p) for b in batches for k, u, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name, version, n = f"part-{part:06d}-{made:04d}.arc.gz", 1 + part % 2, 0

            def body(out) -> None:
                nonlocal row, n
                out.write(gzip.compress(arc_head(version, name, date), LEVEL, mtime=0))
                written = 0
                while row is not None and written < ARCHIVE_BYTES:
                    key, url, payload = row
                    content = http_message((payload or "").encode("utf-8"), key)
                    head = {"URL": _safe(url, "urn:null"), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(content))}
                    written += out.write(gzip.compress(arc_line(version, head) + content + b"\n", LEVEL, mtime=0))
                    n += 1
                    row = next(rows, None)

            into_place(folder, name, body)
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n_records"])

    rows = pages.select(F.col(key_col).cast("long").alias("k"), F.col(url_col).alias("u"), F.col(payload_col).alias("p"))
    return materialize(rows.mapInArrow(run, "file string, n_records long"), "arc-files")


# HTTP and WARC


def http_parts(content: bytes) -> tuple[bytes, bytes, dict[str, str]] | None:
    """(header block, payload, fields by lower-case name) of an HTTP message; None for anything else."""
    if not content.startswith(b"HTTP/"):
        return None
    end = content.find(b"\r\n\r\n")
    size = 4
    if end < 0:
        end, size = content.find(b"\n\n"), 2
    if end < 0:
        return None
    head = content[: end + size]
    fields = (line.partition(":") for line in head.decode("latin-1").splitlines()[1:])
    return head, content[end + size :], {k.strip().lower(): v.strip() for k, _, v in fields if k.strip()}


def warc_date(arc_date: str) -> str:
    """An ARC date of up to fourteen digits as an ISO timestamp."""
    d = (re.sub(r"\D", "", arc_date) + "0" * 14)[:14]
    month, day = max("01", d[4:6]), max("01", d[6:8])
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file.rsplit("/", 1)[-1]}#{place}')}>"


def warc_record(kind: str, file: str, place: int, head: dict[str, str], content: bytes, refers: tuple | None = None) -> bytes:
    """One record. ``refers``: (file, place, url, date, key) of the response that has a revisit's payload."""
    parts = http_parts(content)
    payload = parts[1] if parts else content
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(file, place)), ("WARC-Date", warc_date(head["Archive-date"]))]
    if kind == "warcinfo":
        block, mime = b"software: spanloom\r\nformat: WARC File Format 1.1\r\nconverted-from: " + head["URL"].encode("utf-8", "surrogateescape") + b"\r\n", "application/warc-fields"
        payload = None
    else:
        block, mime = content, "application/http; msgtype=response" if parts else head["Content-type"]
        fields.append(("WARC-Target-URI", head["URL"]))
        if head.get("IP-address") not in (None, "-", "0.0.0.0"):
            fields.append(("WARC-IP-Address", head["IP-address"]))
    if refers is not None:
        block = parts[0] if parts else b""
        fields += [(LENGTH_FIELD, str(len(payload))), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], refers[1])), ("WARC-Refers-To-Target-URI", refers[2]), ("WARC-Refers-To-Date", warc_date(refers[3]))]
        if refers[4] is not None:
            fields.append(("WARC-Refers-To-Key", str(refers[4])))
    if payload is not None:
        fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    fields += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record; a block that belies its digest is an error."""
    data = _members(stream)
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record has to begin with its version")
        fields: dict[str, str] = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = data.read(int(fields["content-length"]))
        if fields.get("warc-block-digest", "") not in ("", f"sha1:{sha1_base32(block)}"):
            raise ValueError("a block differs from its digest")
        yield fields, block


# Spark


def _files(files: DataFrame) -> DataFrame:
    """One file a row, each in a task of its own as far as partitions go."""
    n = max(1, files.count())
    return files.select("file").repartition(n, "file")


def _stream(uri: str):
    files, path = open_uri(uri)
    return files.open_input_file(path)


def scan_arc(files: DataFrame) -> DataFrame:
    """(file, place, key, url, date, digest, n_bytes) of every record but version blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with _stream(file) as f:
                    for place, (head, content) in enumerate(read_arc(f)):
                        if place:
                            parts = http_parts(content)
                            payload = parts[1] if parts else content
                            key = parts[2].get(KEY_FIELD.lower()) if parts else None
                            rows.append((file, place, int(key) if key is not None else None, head["URL"], head["Archive-date"], sha1_base32(payload), len(payload)))
                        if len(rows) >= 8192:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "place", "key", "url", "date", "digest", "n_bytes"])

    return _files(files).mapInArrow(run, "file string, place long, key long, url string, date string, digest string, n_bytes long")


def convert(files: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a WARC beside every ARC of ``files`` (its ``file`` column) into ``folder``; (file, n_records) of each."""
    records = materialize(scan_arc(files), "arc-records")
    order = F.struct(F.col("key").isNotNull().alias("has"), "key", "file", "place", "url", "date")
    # Only payloads that recur need a verdict; copies are counted before they meet.
    repeated = records.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max(order).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    judged = records.select("file", "place", "digest", "n_bytes").join(repeated, ["digest", "n_bytes"], "left")
    own = (F.col("to.file") == F.col("file")) & (F.col("to.place") == F.col("place"))
    verdicts = judged.select("file", "place", F.when(~own, F.col("to")).alias("to"))
    # A file without records still has its version block.
    verdicts = verdicts.unionByName(files.select("file", F.lit(0).cast("long").alias("place"), F.lit(None).cast(verdicts.schema["to"].dataType).alias("to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            file = row[0]
            name = re.sub(r"\.arc(\.gz)?$", "", file.rsplit("/", 1)[-1]) + ".warc.gz"
            n = 0

            def body(out) -> None:
                nonlocal row, n
                with _stream(file) as f:
                    for place, (head, content) in enumerate(read_arc(f)):
                        if row is None or row[:2] != (file, place):
                            raise ValueError("the archive changed since it was scanned")
                        to = row[2]
                        kind = "warcinfo" if not place else "revisit" if to else "response" if http_parts(content) else "resource"
                        refers = (to["file"], to["place"], to["url"], to["date"], to["key"]) if to else None
                        out.write(gzip.compress(warc_record(kind, file, place, head, content, refers), LEVEL, mtime=0))
                        n += 1
                        row = next(rows, None)

            into_place(folder, name, body)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n_records"])

    # An archive is rewritten by one task, and there are as many tasks as archives, however small their verdicts are.
    ordered = verdicts.repartition(max(1, files.count()), "file").sortWithinPartitions("file", "place")
    return materialize(ordered.mapInArrow(run, "file string, n_records long"), "warc-files")


def records(files: DataFrame) -> DataFrame:
    """(key, url, record_id, record_type, payload_bytes, payload_digest, refers_to, refers_to_id) of WARC records that have a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = ["key", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_id"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with _stream(file) as f:
                    for fields, block in read_warc(f):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, payload, http = http_parts(block) or (b"", block, {})
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and digest != sha1_base32(payload):
                            raise ValueError("a payload differs from its digest")
                        size = int(fields.get(LENGTH_FIELD.lower()) or http.get("content-length", 0)) if kind == "revisit" else len(payload)
                        key, to = http.get(KEY_FIELD.lower()), fields.get("warc-refers-to-key")
                        rows.append((int(key) if key is not None else None, fields["warc-target-uri"], fields["warc-record-id"], kind, size, digest, int(to) if to is not None else None, fields.get("warc-refers-to")))
                        if len(rows) >= 8192:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return _files(files).mapInArrow(run, "key long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = write_arc(table(spark, sf_dir, "pages"), new_dir(spark, "arc"))
    warcs = convert(arcs, new_dir(spark, "warc"))
    return records(warcs).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top FROM p),
d AS (
  SELECT h.*, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      (instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INTEGER) + 1, 1)) - 1) * 16
      + (CASE WHEN i * 5 // 4 < 39 THEN instr('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INTEGER) + 2, 1)) - 1 ELSE 0 END)
    ) // CAST(power(2, 3 - i % 4) AS INTEGER) % 32 AS INTEGER), 1)), 'string_agg', '') AS b32
  FROM h
)
SELECT page_id, payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_arc_to_warc": op2_arc_to_warc}
SQL = {"op2_arc_to_warc": OP2_SQL}
