"""WARC archives: a writer that marks repeated payloads as revisits, and a splittable reader.

Writer: Spark's text writer (with its commit protocol) writes one gzip member for each record, byte for byte; see
:func:`write_archives`. Reader: files are cut into byte ranges; a task looks for gzip magic from its range's start,
validates each candidate member by decoding its WARC header, and owns the records that start inside its range, as
far as they reach beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry the pages' ids as their own.
ID = "urn:x-page:"

STEP = 1 << 20
MOST_TASKS = 50_000
RECORD = ("page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to string, payload binary")


def member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


EMPTY = member(b"")


def line_of(record: bytes) -> bytes:
    """A gzip member without its last byte, which is 0 (the top byte of the length) and is written as line end. A
    record of 16 MiB and more, where it is not, is followed by an empty member, which is."""
    m = member(record)
    return m[:-1] if m[-1:] == b"\0" else m + EMPTY[:-1]


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = quote(url or "", safe="/:?#[]@!$&'()*+,;=-._~%").encode()
    head = [
        VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>".encode(), b"WARC-Date: " + date.encode(),
        *([b"WARC-Target-URI: " + uri] if url is not None else []), b"WARC-Payload-Digest: sha1:" + digest.encode(),
        *([f"WARC-Refers-To: <{ID}{refers_to}>".encode(), b"WARC-Profile: " + PROFILE] if revisit else []),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the smallest page_id with an equal payload where that is
    another row's and the payload has at least ``min_bytes`` bytes, else null."""
    src = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("sha1", F.sha1("payload"))
    shared = (src.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    found = src.join(shared, "sha1", "left")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; null html: empty payload) as gzip members into
    part files below ``folder``. Of rows with equal payloads the smallest page_id is a response, others revisit it.

    Spark's text writer ends each row with a line end; here that is the byte 0 that ends a member (see
    :func:`line_of`), so the files are plain WARC.gz, and lost executors are its commit protocol's matter."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            lines = [line_of(record(i, u, p, digest_of(p), r, r is not None, date))
                     for i, u, p, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    lines = mark_revisits(pages, min_bytes).mapInArrow(run, "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)


def open_file(uri: str):
    """A seekable file of a URI that Spark lists: a shared local path, or a store that pyarrow knows."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def decode(f, start: int):
    """The member at byte ``start``: (its end, its bytes), or None if it is none or not a whole WARC record. Stops
    early if the decoded bytes are no WARC header."""
    f.seek(start)
    d = zlib.decompressobj(31)
    out, size, end = [], 0, start
    while not d.eof:
        raw = f.read(STEP if out else 1 << 14)
        if not raw:
            return None
        try:
            out.append(d.decompress(raw))
        except zlib.error:
            return None
        end += len(raw) - len(d.unused_data)
        size += len(out[-1])
        if len(out) == 1 and not out[0].startswith(b"WARC/"[:len(out[0])]):
            return None
    return end, b"".join(out)


def parse(raw: bytes):
    """(headers, block) of a WARC record, or None."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    headers = {}
    for x in lines[1:]:
        k, _, v = x.partition(b":")
        headers[k.strip().lower()] = v.strip()
    size = headers.get(b"content-length", b"")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return headers, rest[:int(size)]


def records_of(f, lo: int, hi: int):
    """Parsed records whose members start in [lo, hi)."""
    at = lo
    while at < hi:
        f.seek(at)
        window = f.read(min(STEP, hi - at) + len(MAGIC) - 1)
        k = window.find(MAGIC)
        if k < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        if at + k >= hi:
            return
        found = decode(f, at + k)
        got = parse(found[1]) if found else None
        if got:
            yield got
            at = found[0]
        else:
            at += k + 1


def row_of(headers, block: bytes):
    kind = headers.get(b"warc-type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    named = headers.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode()
    text = lambda k: headers[k].decode() if k in headers else None
    ident = lambda k: re.sub(rf"^<{re.escape(ID)}(.*)>$", r"\1", text(k) or "") or None
    if kind == "response":
        size, digest = len(payload), digest_of(payload)
        if named and named != digest:
            raise ValueError(f"payload digest of {headers.get(b'warc-record-id')!r} is {digest}, not {named}")
    else:
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, digest, payload = int(m[1]) if m else None, named, None
    return (ident(b"warc-record-id"), text(b"warc-target-uri"), size, digest, kind, ident(b"warc-refers-to"), payload)


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the archives below ``folder``: page_id and refers_to as strings (the
    records' ids), url, payload_bytes and payload_digest (of the full payload; a response's are worked out anew and
    compared with its header), record_type, payload (null for a revisit, or without ``payloads``).

    Files are listed by Spark and cut into ranges of ``split_bytes``, dealt over as many tasks (at most MOST_TASKS); a range without a member
    start yields nothing. Other record types and bytes between members are passed over. An empty folder has no
    rows."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("lo"))

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path, length, lo in zip(*(b.column(c).to_pylist() for c in ("path", "length", "lo")), strict=True):
                with open_file(path) as f:
                    rows, held = [], 0
                    for headers, block in records_of(f, lo, min(lo + split_bytes, length)):
                        row = row_of(headers, block)
                        if row:
                            rows.append(row if payloads else (*row[:6], None))
                            held += len(block) if payloads else 100
                        if held > STEP:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    # an explicit number: the ranges' rows are tiny, and AQE would read all archives in one task
    return ranges.repartition(min(MOST_TASKS, max(1, ranges.count()))).mapInArrow(run, RECORD)
