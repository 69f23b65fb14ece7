"""WARC archives: a writer of gzip records and a reader that salvages what is behind damage.

The writer puts every record into a gzip member of its own; Spark's text writer sets an empty
member (a fixed 20 bytes) between them and commits whole files, so a lost executor leaves no
half archive. Of records with equal payloads of at least ``min_bytes`` the one with the
smallest id is a response, others are revisits that refer to it.

The reader goes through members, or version lines of uncompressed records. A record counts if
its header can be read, its block has the stated length and ends as it must, and its payload has
the stated digest. Behind anything else it searches for the next member or version line at which a
record counts, goes on from there, and logs the bytes between as a gap. The same is done with the content of a member
that holds several records, and with what can be decompressed of a damaged one: such gaps have
the member's range in the archive and, in ``inner_offset`` and ``inner_length``, their own in its content. A
member that breaks off gives the records before that, the one that ends just there too, and a gap
from the byte at which it breaks off. Every search goes on from where the last one stopped.

Defined results: a null payload is empty; rows that share the smallest id of a payload are all
responses, as are rows without id that share theirs with no row that has one; line ends in a URL
are escaped; an empty table writes no record and reads none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm.tables import map_lists

EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
END = b"\r\n\r\n"
CUT = "member without end"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: An archive file is cut after so many records.
RECORDS_PER_FILE = 2000


def base32_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hexadecimal: five digits make four characters."""
    groups = [
        F.translate(
            F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for i in range(8)
    ]
    return F.concat(*groups)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``first`` given) has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    target = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    return "\r\n".join(lines).encode() + END + block + END


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for every row of (page_id, url, html) to archives in the folder ``path``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"))
    digests = own.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("n"))
    # Only rows that revisit another are carried to their page: ids, never payloads.
    firsts = (
        digests.filter(F.col("n") >= min_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
        .select("sha1", "first")
    )
    described = own.withColumn("sha1", F.sha1("payload")).withColumn("n", F.length("payload"))
    # The pages' side is as large as the payloads; few digests have copies, so the planner may
    # broadcast them, and it splits a digest that many pages share.
    revisits = (
        digests.filter(F.col("n") >= min_bytes)
        .join(firsts, "sha1")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), "first")
        .distinct()
    )
    joined = described.join(revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("sha1") == F.col("_s")), "left")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = zip(b["page_id"], b["url"], b["payload"], b["first"], strict=True)
            yield {
                "value": [gzip.compress(record(p, u, x, digest_of(x), f, date), 6, mtime=0) for p, u, x, f in rows]
            }

    (
        map_lists(joined.select("page_id", "url", "payload", "first"), "value binary", run)
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


@dataclass
class Found:
    """A record, or with ``reason`` a gap, at a byte range of an archive."""

    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int | None = None
    reason: str | None = None
    inner: tuple[int, int] | None = None  # a gap's place in the content of a member


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[Found, int]:
    """The record at ``at`` and where it ends; raises Damaged if a check fails."""
    if not (m := VERSION.match(data, at)):
        raise Damaged("no version line")
    # A header ends before the next record begins: no search goes past that.
    limit = data.find(b"\r\nWARC/1.", m.end() - 2)
    end = data.find(END, m.end() - 2, len(data) if limit < 0 else limit + 2)
    if end < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("header line without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if missing := [x for x in MANDATORY if x not in headers]:
        raise Damaged(f"no {missing[0]}")
    size = headers["content-length"]
    if not size.isdigit():
        raise Damaged("no block length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != END:
        raise Damaged("block does not end where it should")
    block = data[start:stop]
    payload, total = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(END)
        if not blank:
            raise Damaged("HTTP head without end")
        lengths = re.findall(rb"(?im)^content-length:\s*(\d+)\s*$", head + b"\r\n")
        total = int(lengths[0]) if lengths else len(payload)
    kind = headers["warc-type"]
    stated = headers.get("warc-payload-digest", "")
    if kind != "revisit" and stated.startswith("sha1:") and stated[5:] != digest_of(payload):
        raise Damaged("payload differs from its digest")
    return Found(at, stop + 4 - at, headers, None if kind == "revisit" else payload, total), stop + 4


def _member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What can be decompressed of the gzip member at ``at``, where that ends, and what is wrong with it."""
    d, out, pos, step, bad = zlib.decompressobj(31), [], at, 65536, -1
    while not d.eof:
        if pos >= len(data):
            return b"".join(out), len(data), CUT
        if pos == bad:
            step = 1  # by single bytes, for what stands before the damage
        try:
            out.append(d.decompress(data[pos : pos + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"member: {e}"
            d, out, pos, bad = zlib.decompressobj(31), [], at, pos
            continue
        pos += step
    return b"".join(out), min(pos, len(data)) - len(d.unused_data), None


def _inside(content: bytes) -> Iterator[Found]:
    """Records that count and gaps between them, by their places in a member's content."""
    at, lost, reason = 0, None, ""
    while at < len(content):
        try:
            found, end = parse_record(content, at)
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            at = content.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            continue
        if lost is not None:
            yield Found(lost, at - lost, reason=reason)
            lost = None
        yield found
        at = end
    if lost is not None:
        yield Found(lost, len(content) - lost, reason=reason)


def _at(data: bytes, view: memoryview, at: int) -> tuple[list[Found], int, str | None]:
    """Records, and gaps inside, of the member or the uncompressed record at ``at``, where it ends, and what is wrong with it."""
    if not data.startswith(MAGIC, at):
        found, end = parse_record(data, at)
        return [found], end, None
    content, end, wrong = _member(view, at)
    inside = list(_inside(content))
    if all(x.reason for x in inside) and (inside or wrong):
        raise Damaged(wrong or inside[0].reason)
    for x in inside:
        if x.reason:
            x.inner = (x.offset, x.length)
        x.offset, x.length = at, end - at
    return inside, end, wrong


def salvage(data: bytes) -> Iterator[Found]:
    """All records that count, and the gaps between and inside of members, in order.

    Behind a damaged member the search goes on from its second byte, since its end may be missing.
    """
    view, at, lost, reason = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            found, end, wrong = _at(data, view, at)
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            at = _next(data, at)
            continue
        if found and lost is not None:
            lost = min(lost, at)
            yield Found(lost, at - lost, reason=reason)
            lost = None
        yield from found
        if wrong:
            lost, reason, at = end, wrong, _next(data, at)
        else:
            at = end
    if lost is not None:
        yield Found(lost, len(data) - lost, reason=reason)


def _next(data: bytes, at: int) -> int:
    """The next place behind ``at`` at which a member or a record may begin."""
    m = START.search(data, at + 1)
    return m.start() if m else len(data)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record and per gap: file, offset, length, reason (gaps), headers, payload, payload_bytes,
    inner_offset and inner_length (gaps inside a member).

    A file is one row on its way to a task, so it has to fit one: up to some hundred MB.
    """
    schema = (
        "file string, offset long, length long, reason string, headers map<string,string>, "
        "payload binary, payload_bytes long, inner_offset long, inner_length long"
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                found: list[Found] = []
                size = 0
                for x in salvage(content):
                    found.append(x)
                    size += len(x.payload or b"")
                    if size > 8_000_000 or len(found) >= 5000:
                        yield _columns(name, found)
                        found, size = [], 0
                yield _columns(name, found)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_lists(files, schema, run)


def _columns(name: str, found: list[Found]) -> dict[str, list]:
    return {
        "file": [name] * len(found),
        "offset": [x.offset for x in found],
        "length": [x.length for x in found],
        "reason": [x.reason for x in found],
        "headers": [list(x.headers.items()) for x in found],
        "payload": [x.payload for x in found],
        "payload_bytes": [x.payload_bytes for x in found],
        "inner_offset": [x.inner and x.inner[0] for x in found],
        "inner_length": [x.inner and x.inner[1] for x in found],
    }


def records(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records."""

    def page(name: str) -> Column:
        text = F.regexp_extract(F.col("headers")[name], "^<urn:page:(-?[0-9]+)>$", 1)
        return F.when(text != "", text.cast("long"))

    return found.filter("reason is null").select(
        page("warc-record-id").alias("page_id"),
        "payload_bytes",
        F.regexp_extract(F.col("headers")["warc-payload-digest"], "^sha1:(.*)$", 1).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


def gaps(found: DataFrame) -> DataFrame:
    return found.filter("reason is not null").select("file", "offset", "length", "inner_offset", "inner_length", "reason")
