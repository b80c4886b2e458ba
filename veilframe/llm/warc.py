"""WARC archives: a writer of responses and revisits, and a salvaging reader.

The reader checks each record (headers, length, end, digests). After a failed check it looks for the
next version line or gzip member at which a valid record starts, goes on there, and logs the bytes
between as quarantined. Archives are written and read by Spark's own sources, so they can lie in any
store it reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import if_small, join_groups, slices, written

RECORDS_PER_FILE = 2000
#: A file written holds no more bytes, unless one record alone does: records too large for RECORDS_PER_FILE of them go to files of fewer.
FILE_BYTES = 1 << 30
#: Bytes of a record besides its payload and its url, at most.
HEAD_BYTES = 1024
#: Revisits (two ids and a digest: 36 bytes) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_REVISITS = 500_000
#: Bytes of a gzip member that are unpacked at once.
READ_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_IDS = 0x5645494C4652414D << 64  # the upper half of record ids; the lower half is the page id
_NO_ID = 2**63 - 1
_version = re.compile(rb"WARC/1\.[01]\r\n")
_start = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
#: Header fields that a record's checks go by.
_DECIDING = (b"content-length", b"content-type", b"warc-type", b"warc-block-digest", b"warc-payload-digest")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_IDS | page_id % 2**64)}>"


def page_id(record: str | None) -> int | None:
    """The page that a record id of ours stands for; None for other ids."""
    try:
        number = uuid.UUID((record or "").strip("<> ")).int
    except ValueError:
        return None
    low = number - _IDS
    if not 0 <= low < 2**64:
        return None
    low = low - 2**64 if low >= 2**63 else low
    return None if low == _NO_ID else low


def make_record(page: int, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record without the empty lines that end it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out = []
        for own, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("_id", "url", "html", "refers_to")), strict=True):
            payload = (html or "").encode()
            out.append(make_record(own, url, payload, digest(payload), refers_to).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record per row of pages: uncompressed archives of records_per_file records at most, in the folder `path`.

    No file is larger than file_bytes unless it holds a single record that is.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least min_bytes bytes, those with the
    smallest page id are responses, the others revisits that refer to it. Smaller payloads are all
    responses. Rows without a page id come last in that order. Control characters in urls are
    percent-encoded; null urls are left out. An empty table makes an archive without records.

    Digests are grouped, not payloads; a payload that a large share of the pages has is joined apart.
    """
    sha1 = F.unhex(F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary")))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), sha1.alias("digest"))
    digests = written(rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).select("_id", "digest"), "digests")
    firsts = written(digests.groupBy("digest").agg(F.min("_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "firsts")
    revisits = join_groups(digests, firsts, "digest", "copies", digests.count()).filter("refers_to is not null and _id > refers_to")
    revisits = written(revisits.select("_id", "digest", "refers_to").distinct(), "revisits")  # rows can share an id, so its payload's digest too
    joined = rows.join(if_small(revisits, BROADCAST_REVISITS), ["_id", "digest"], "left")
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES
    bound, most = file_bytes // records_per_file, rows.agg(F.max(size)).first()[0] or 0

    def write(some: DataFrame, number: int) -> None:
        records = some.select("_id", "url", "html", "refers_to").mapInArrow(_records, "value string")
        records.write.mode("append").option("lineSep", _END.decode()).option("maxRecordsPerFile", number).text(path)

    write(joined.filter(size <= bound), records_per_file)
    while bound < most:  # records of up to 16 times the size, as many fewer in a file
        write(joined.filter((size > bound) & (size <= 16 * bound)), max(1, file_bytes // (16 * bound)))
        bound *= 16


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        found[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found


class Headers:
    """Where the header lines after a version line end. What is known of lines already read is kept, so that the version lines of damaged bytes cost no more than one pass over them."""

    def __init__(self, data: bytes):
        self.data = data
        self.low, self.stop, self.wrong = 0, -1, ""  # lines from low to stop are read; stop is the empty line, or wrong says what is
        self.last: dict[bytes, int] = {}  # where the last line of each deciding field begins
        self.failed, self.reason = -1, ""  # lines up to this one fail with all that follow

    def end(self, at: int) -> int:
        """Place of the empty line that ends the lines from `at` on; ValueError if there is none, or if records with these lines have failed before."""
        if not self.low <= at <= self.stop:
            self.low, self.last, self.failed = at, {}, -1
            while True:
                close = self.data.find(b"\r\n", at)
                colon = self.data.find(b":", at, close) if close > at else -1
                if close == at or colon < 0:
                    self.stop, self.wrong = at, "" if close == at else "headers without an end" if close < 0 else "header line without a colon"
                    break
                name = self.data[at:colon].strip().lower()
                if name in _DECIDING:
                    self.last[name] = at
                at = close + 2
            at = self.low
        if self.wrong:
            raise ValueError(self.wrong)
        if at <= self.failed:
            raise ValueError(self.reason)
        return self.stop

    def fail(self, at: int, reason: str) -> None:
        """The record with the lines from `at` on fails, and so do all that begin later but before the last lines it was judged by."""
        self.failed, self.reason = min([x for x in self.last.values() if x >= at], default=self.stop), reason
        raise ValueError(reason)


def parse_record(data: bytes, at: int, headers: Headers | None = None) -> tuple[dict[str, Any], int]:
    """The record that starts at a version line, and where it ends; ValueError says which check failed."""
    headers = headers or Headers(data)
    opened = _version.match(data, at)
    if not opened:
        raise ValueError("no version line")
    first = opened.end()
    close = headers.end(first)
    if close == first:
        raise ValueError("no content length")
    if b"content-length" not in headers.last or headers.last[b"content-length"] < first:
        headers.fail(first, "no content length")
    fields = _fields(data[first : close - 2])
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        headers.fail(first, "no content length")
    start = close + 2
    end = start + int(fields["content-length"][:20])
    if end > len(data) or data[end : end + len(_END)] != _END:
        headers.fail(first, "no end where the content length says")
    block = data[start:end]
    kind, _, value = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and value != digest(block):
        headers.fail(first, "block digest differs")
    record = {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "fields": fields, "payload": block, "payload_bytes": len(block)}
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(_END)
        record["payload"] = payload
        record["payload_bytes"] = len(payload)
        if record["type"] == "revisit":  # the payload is elsewhere; its length is in the HTTP headers
            length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", head)
            record["payload_bytes"] = int(length[1]) if length else None
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    if record["type"] != "revisit" and kind == "sha1" and value != digest(record["payload"]):
        headers.fail(first, "payload digest differs")
    record["payload_digest"] = value if kind == "sha1" else None
    return record, end + len(_END)


def _known(record: dict[str, Any]) -> tuple:
    return tuple(sorted(record["fields"].items())), hashlib.sha1(record["payload"]).digest()


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The gzip member that starts here, as far as it unpacks; where that ends, and why it goes no further (empty: it is whole)."""
    unpack, parts, view, read, step = zlib.decompressobj(31), [], memoryview(data), at, READ_BYTES
    while read < len(data) and not unpack.eof:  # in steps, as what follows the member would be copied whole
        before = unpack.copy() if step > 1 else None
        try:
            parts.append(unpack.decompress(view[read : read + step]))
        except zlib.error as e:
            if before is None:
                return b"".join(parts), read, f"gzip: {e}"
            unpack, step = before, 1  # once more by bytes, as a failing step puts nothing out
            continue
        read = min(read + step, len(data))
    return b"".join(parts), read - len(unpack.unused_data), "" if unpack.eof else "gzip member without an end"


def salvage(data: bytes, packed: bool = True) -> Iterator[dict[str, Any]]:
    """Valid records of an archive in order, as dicts with offset and length; bytes that belong to none as dicts with a reason.

    Records and gaps of a gzip member have the member's offset and length. Records of a member that does
    not unpack to its end have length 0: its bytes are the gap after them. Damaged bytes are read once,
    whatever version lines they hold, but for blocks whose ends are where their lengths say and whose
    digests differ.
    """
    at, broken, reason, headers = 0, None, "", Headers(data)
    held, tried = set(), 0  # records of the last broken member, and where it stopped: stored bytes can show them again
    while at < len(data):
        found, why = [], ""
        try:
            if packed and data[at : at + 3] == b"\x1f\x8b\x08":
                inner, end, why = _unpack(data, at)
                found = list(salvage(inner, False))
                if (inner or why) and all("reason" in f for f in found):
                    raise ValueError(why or found[0]["reason"])
            else:
                record, end = parse_record(data, at, headers)
                if at < tried and _known(record) in held:
                    raise ValueError(reason)
                found = [record]
        except ValueError as e:
            if broken is None:
                broken, reason = at, str(e)
        else:
            if broken is not None:
                yield {"offset": broken, "length": at - broken, "reason": reason}
                broken = None
            for record in found:
                yield record | {"offset": at, "length": 0 if why else end - at}
            if not why:
                at = end
                continue
            held, tried = {_known(f) for f in found if "reason" not in f}, end
            broken, reason = at, why
        again = _start.search(data, at + 1)
        at = again.start() if again else len(data)
    if broken is not None:
        yield {"offset": broken, "length": len(data) - broken, "reason": reason}


_SCHEMA = "file string, offset long, length long, reason string, type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under path (plain, or gzip with any number of records a member), and quarantined gaps.

    Columns: file, offset, length (bytes in the file), reason (why a gap is quarantined; null for
    records), type, record_id, target_uri, refers_to, payload_bytes, payload_digest and, if asked for,
    payload. A file is read by one task and must be under 2 GB, the most that Spark's binary source takes.
    Empty files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                held, size, file = [], 0, batch.column("path")[k].as_py()
                for found in salvage(batch.column("content")[k].as_py()):
                    if not payloads:
                        found["payload"] = None
                    held.append((file, *(found.get(n) for n in names[1:])))
                    size += len(found.get("payload") or b"")
                    if len(held) >= 1000 or size > 1 << 24:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page id) of records that write_archive made."""
    low = lambda c: F.conv(F.regexp_replace(F.regexp_extract(c, r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-([0-9a-f]{4}-[0-9a-f]{12})", 1), "-", ""), 16, -10).cast("long")
    return records.filter("reason is null").select(
        F.when(low("record_id") != _NO_ID, low("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", low("refers_to")).alias("refers_to")
    )
