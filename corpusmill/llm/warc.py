"""WARC archives: written with one gzip member per record, read back by byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import col, same
from corpusmill.session import materialize, scratch_path

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT_BYTES = 100
#: Bytes of an archive in one range.
SPLIT_BYTES = 16 << 20
#: Each range has a task of its own up to so many; then a task scans several, one after the other.
MOST_TASKS = 100_000
#: Bytes read at a time.
CHUNK_BYTES = 1 << 18

_MAGIC = b"\x1f\x8b\x08"
_DATE = "1970-01-01T00:00:00Z"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat an earlier payload.

    Of equal payloads of LEAST_REVISIT_BYTES or more the record with the
    smallest page_id is the response. Only ids and digests are shuffled;
    payloads are not. Rows that share the smallest page_id are all responses;
    a null page_id neither is referred to nor refers.
    """
    payload = F.coalesce(col("html"), F.lit(""))
    rows = pages.select(col("page_id").cast("long").alias("page_id"), payload.alias("p")).where("page_id IS NOT NULL")
    rows = rows.where(F.octet_length("p") >= LEAST_REVISIT_BYTES).select("page_id", F.sha2("p", 256).alias("digest"))
    rows = materialize(rows, "warc-digests")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first.select(F.col("digest").alias("d"), "refers_to"), (F.col("digest") == F.col("d")) & (F.col("page_id") != F.col("refers_to")))
    return later.select("page_id", "digest", "refers_to").distinct()


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode("utf-8")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One gzip member with a response, or a revisit without the payload. The HTTP header tells the full payload's length in both."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    fields += [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE)]
    fields += [("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._"))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(_header(fields, "WARC/1.1")) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder``, a URI or a local path, and returns the files (path, bytes, records).

    Each task attempt writes a file of its own name; the list of files is a
    committed table, so what a lost or repeated attempt wrote is not read.
    """
    later = revisits(pages).select(F.col("page_id").alias("rp"), F.col("digest").alias("rd"), "refers_to")
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), F.coalesce(col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    joined = rows.join(later, same(F.col("page_id"), F.col("rp")) & (F.col("digest") == F.col("rd")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        file = f"{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            binary = batch.column(2).cast(pa.binary())
            ids, urls, digests, refers = (batch.column(i) for i in (0, 1, 3, 4))
            for i in range(batch.num_rows):
                out = out or store.open_output_stream(f"{base}/{file}", compression=None)
                member = encode_record(ids[i].as_py(), urls[i].as_py(), binary[i].as_py(), refers[i].as_py(), digests[i].as_py())
                out.write(member)
                size += len(member)
                records += 1
            del batch, binary, ids, urls, digests, refers
            pa.default_memory_pool().release_unused()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{file}"]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])

    return materialize(joined.mapInArrow(write, "path string, bytes long, records long"), "warc-files")


class _Window:
    """Reads a file forwards from any place, holding one stretch of it."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        end = min(self.size, at + n)
        if at < self.at or end > self.at + len(self.held):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(min(self.size - at, max(n, CHUNK_BYTES)))
        return self.held[at - self.at : end - self.at]


_FIRST = re.compile(rb"WARC/1\.[01]\r\n")
_FIRST_BYTES = 10


def _head(window: _Window, at: int) -> bytes | None:
    """The first bytes of the member at ``at`` up to the end of its header, however long that is; None where it is no record."""
    inflate, held, place, looked = zlib.decompressobj(31), bytearray(), at, 0
    try:
        while place < window.size and not inflate.eof:
            chunk = window.read(place, 4096 if place == at else CHUNK_BYTES)
            held += inflate.decompress(chunk)
            place += len(chunk)
            if len(held) >= _FIRST_BYTES and not _FIRST.match(held):
                return None
            if held.find(b"\r\n\r\n", looked) >= 0:
                return bytes(held)
            looked = max(0, len(held) - 3)
    except zlib.error:
        pass
    return None


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated member at ``at`` and where it ends; None where it isn't whole."""
    inflate, parts, place = zlib.decompressobj(31), [], at
    try:
        while place < window.size and not inflate.eof:
            chunk = window.read(place, CHUNK_BYTES)
            parts.append(inflate.decompress(chunk))
            place += len(chunk)
    except zlib.error:
        return None
    return (b"".join(parts), place - len(inflate.unused_data)) if inflate.eof else None


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC header and its length; None where the bytes don't begin with one."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not _FIRST.match(data):
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def scan_range(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records that begin in [start, end).

    A gzip magic inside compressed data is told from a record by inflating and
    reading the header. A record is read to its end, past the range where it
    must. Once one is found the next begins where it ends; where that is no
    record, the scan goes on byte by byte.
    """
    window, at = _Window(source, size), start
    while at < end:
        if window.read(at, 3) != _MAGIC:
            chunk = window.read(at, min(CHUNK_BYTES, end - at + 2))
            found = chunk.find(_MAGIC)
            if found < 0:
                at += max(1, len(chunk) - 2)
                continue
            at += found
            if at >= end:
                return
        head = _head(window, at)
        if head is None or parse_header(head) is None or (full := _member(window, at)) is None:
            at += 1
            continue
        fields, begin = parse_header(full[0])
        length = int(fields["content-length"])
        if len(full[0]) < begin + length:
            at += 1
            continue
        yield at, fields, full[0][begin : begin + length]
        at = full[1]


def _page(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``files`` (path, bytes) below one file system, whatever the size of a file.

    Columns: page_id, url, payload_bytes, payload_digest (of the full payload), record_type, refers_to, file, place,
    and payload on request (null for revisits). A response's digest is computed from its bytes. Ranges are dealt out to as
    many tasks as the bytes give.
    """
    total = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0)).alias("n")).first()["n"]
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "bytes", F.explode(pieces).alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, F.col("bytes")))
    spread = ranges.repartition(max(1, min(int(total), MOST_TASKS)))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, place long" + ", payload binary" * with_payload
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.strip().split(" ")[0], types[x.strip().split(" ")[1]]) for x in schema.split(",")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as source:
                    for place, fields, block in scan_range(source, size, start, stop):
                        head = block.find(b"\r\n\r\n") + 4
                        kind, payload = fields["warc-type"], block[head:]
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        if kind == "revisit":
                            told = re.search(rb"(?im)^content-length:\s*(\d+)", block[:head])
                            count, payload = int(told[1]) if told else None, None
                        else:
                            count, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        row = [_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), count, digest, kind, _page(fields.get("warc-refers-to")), path, place]
                        rows.append(row + [payload] * with_payload)
                        held += len(payload or b"") if with_payload else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=arrow)

    return spread.mapInArrow(scan, schema)


def checked(records: DataFrame, files: DataFrame) -> DataFrame:
    """The records, written once; fails where they are not as many as ``files`` (records) counted when they were written."""
    found = materialize(records, "warc-records")
    got = found.count()
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    if got != written:
        raise RuntimeError(f"{written} records were written, {got} were read")
    return found


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive record per row of ``pages`` (page_id, url, html) and reads all of them back by byte ranges.

    Null html is an empty payload; null urls are empty; urls and payloads may
    be of any length. Repeated rows are records of their own. Other columns are
    ignored. An empty table writes no file and gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    files = write_archives(pages, folder)
    return checked(read_archives(spark, files), files)
