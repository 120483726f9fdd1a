"""WARC archives: a writer with revisit records and a reader that salvages records after damage."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, partitions, shared_dir

UID = "__x2_uid"
#: Fixed values of the format: version line, gzip member start and the profile of revisits.
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap boolean, reason string"
_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("gap", pa.bool_()), ("reason", pa.string())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record with an HTTP response head; a revisit keeps the head, whose length is that of the full payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda k: f"<urn:page:{'null' if k is None else k}>"
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    else:
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest(body)}", f"Content-Length: {len(body)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 0, compress: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row, payload the html in UTF-8 (null: empty), and return the manifest: path, n_records, n_bytes.

    Of rows with equal payloads of at least `least` bytes, that with the smallest id is a response and the others are
    revisits of it; smaller payloads are responses all. Null ids come after all others; of repeated rows one is the
    response. A null url is left out of its record. Digests are grouped with partial aggregates and joined back by an
    equi-join, so a payload may be as frequent as it likes. Each task writes one file under a name of its own; only names
    in the written manifest count. pages is read twice and must give its rows in the same order. An empty table gives
    an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias(UID), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", UID)
    sig = materialize(rows.select(UID, "page_id", F.sha1(F.col("html").cast("binary")).alias("sha")).where(F.octet_length("html") >= least), "warc-sig")
    first = sig.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = sig.join(first, "sha").where(F.col(f"first.{UID}") != F.col(UID)).select(UID, F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    plan = rows.join(again, UID, "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
        out, n, size = None, 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id, url, payload, refers_to, revisit)
                data = member(data) if compress else data
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return materialize(plan.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


class Source:
    """A file read forward in blocks, with access to the bytes that are still held."""

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.held, self.start, self.done = stream, block, b"", 0, False

    def need(self, at: int, n: int) -> bytes:
        """Up to n bytes from position at on."""
        while not self.done and self.start + len(self.held) < at + n:
            more = self.stream.read(max(self.block, at + n - self.start - len(self.held)))
            self.done = not more
            self.held += more
        return self.held[at - self.start : at - self.start + n]

    def forget(self, at: int) -> None:
        if at - self.start > self.block:
            self.held, self.start = self.held[at - self.start :], at

    def find(self, marks: tuple[bytes, ...], at: int) -> int:
        """Position of the first mark from at on, or the end of the file; all that is passed is forgotten."""
        keep = max(map(len, marks)) - 1
        while True:
            data = self.need(at, self.block)
            found = [k for m in marks if (k := data.find(m)) >= 0]
            if found:
                return at + min(found)
            if len(data) < self.block:
                return at + len(data)
            at += len(data) - keep
            self.forget(at)


class Damage(Exception):
    pass


def parse(data: bytes) -> tuple[dict, int]:
    """A record at the start of data, checked by its block digest, and its size."""
    if not re.match(rb"WARC/1\.[01]\r\n", data):
        raise Damage("no version line")
    if (cut := data.find(b"\r\n\r\n")) < 0:
        raise Damage("no end of header")
    head = {}
    for line in data[:cut].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header line")
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,15}", head.get("content-length", "")):
        raise Damage("no content length")
    size = int(head["content-length"])
    body = data[cut + 4 : cut + 4 + size]
    if len(body) < size or data[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
        raise Damage("wrong content length")
    if head.get("warc-block-digest", f"sha1:{digest(body)}") != f"sha1:{digest(body)}":
        raise Damage("block digest differs")
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = head.get("warc-type")
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and stated and stated != digest(payload):
        raise Damage("payload digest differs")
    return {
        "page_id": page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": page(head.get("warc-refers-to")),
        "payload_bytes": int(length[1]) if kind == "revisit" and length else len(payload), "payload_digest": stated or digest(payload), "payload": None if kind == "revisit" else payload,
    }, cut + 8 + size


def inflate(src: Source, at: int) -> tuple[bytes, int]:
    """A gzip member from position at on, checked by its CRC, and its compressed size."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            block = src.need(pos, 1 << 16)
            if not block:
                raise Damage("member is cut off")
            out.append(z.decompress(block))
            pos += len(block)
    except zlib.error as e:
        raise Damage(f"gzip: {e}") from e
    return b"".join(out), pos - len(z.unused_data) - at


def plain_record(src: Source, at: int) -> tuple[dict, int]:
    """The uncompressed record at a position and its size; its header and body may have any length."""
    n = 1 << 16
    while b"\r\n\r\n" not in (data := src.need(at, n)) and len(data) == n:
        n *= 4
    size = stated_size(data)
    if size and size > len(data):
        data = src.need(at, size)
    return parse(data)


def stated_size(data: bytes) -> int:
    """Size of the record that data begins with, as its header says; 0 if that can't be read."""
    cut = data.find(b"\r\n\r\n")
    m = re.search(rb"(?i)\r\nContent-Length: *(\d{1,15})\r\n", data[: cut + 2]) if cut >= 0 else None
    return cut + 8 + int(m[1]) if m else 0


def stated_end(src: Source, at: int) -> int | None:
    """Where a damaged plain record ends, if its header's length leads to another record or to the end of the file."""
    size = stated_size(src.need(at, 1 << 16))
    if not size:
        return None
    after = src.need(at, size + 10)[size - 4 :]
    if after[:4] == b"\r\n\r\n" and (len(after) == 4 or after[4:].startswith((MEMBER, VERSION[:5]))):
        return at + size
    return None


def salvage(stream) -> Iterator[dict]:
    """Records and gaps of an archive in order; gaps are the byte ranges that no valid record covers.

    After a failed check the search goes on for the next gzip member or version line: past the damaged record where its
    stated length leads to a record's start, so that text inside it isn't taken for one, else one byte later. A mark that gives
    no valid record is passed over, so a gap ends at the next record that passes all checks. A record is held in
    memory as a whole, whatever its length.
    """
    src, at, gap, why = Source(stream), 0, None, ""
    while start := src.need(at, 5):
        try:
            if start.startswith(MEMBER):
                data, size = inflate(src, at)
                rec, used = parse(data)
                if used != len(data):
                    raise Damage("more than a record in a member")
            elif start == VERSION[:5]:
                rec, size = plain_record(src, at)
            else:
                raise Damage("no record starts here")
        except Damage as e:
            if gap is None:
                gap, why = at, str(e)
            end = stated_end(src, at) if start == VERSION[:5] else None
            at = end if end is not None else src.find((MEMBER, VERSION[:5]), at + 1)
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "gap": True, "reason": why}
            gap = None
        yield {"offset": at, "length": size, "gap": False, **rec}
        at += size
        src.forget(at)
    if gap is not None:
        yield {"offset": gap, "length": at - gap, "gap": True, "reason": why}


def read_warc(paths: DataFrame, strict: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives in column path, plain or with a gzip member per record.

    A row with gap true is a byte range without a valid record: path, offset, length and reason, everything else null. Payloads
    of revisits are null; their length and digest come from the record's headers. Empty files give no rows. strict: paths is a
    manifest, and a file that hasn't its number of records, or has a gap, is an error.
    """
    names = ["path", "n_records"] if strict else ["path"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *want in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, name = filesystem(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, size, seen = [], 0, 0
                    for rec in salvage(stream):
                        seen += not rec["gap"]
                        if want and rec["gap"]:
                            raise ValueError(f"{path}: {rec['length']} bytes at {rec['offset']} hold no valid record: {rec['reason']}")
                        rows.append({"path": path, **rec})
                        size += len(rec.get("payload") or b"")
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, size = [], 0
                    if want and seen != want[0]:
                        raise ValueError(f"{path} has {seen} of {want[0]} records")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return paths.select(*names).repartition(partitions(paths.sparkSession)).mapInArrow(read, RECORDS)
