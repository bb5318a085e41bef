"""WARC archives: writer with revisit records, and a salvage reader (operator 5).

Writing goes through Spark's text sink, so any store that Spark reaches will do: a row is one gzip
member, and the line separator is an empty gzip member, which every reader skips. Reading takes
whole files (the writer bounds records per file) and checks each member and record: gzip CRC,
lengths, block and payload digests. After a failed check the reader searches for the next gzip
magic or version line from which a record passes, goes on there, and logs the bytes between as a
quarantined gap. Inside a member of several records it searches the inflated bytes in the same way,
those before a failure too.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import own_later, maybe_broadcast, saved, scratch_root, steps

VERSION = b"WARC/1.1\r\n"
#: The first bytes of an uncompressed record, and of a gzip member.
LINE, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Records in a file at most; a reader holds one file at a time.
FILE_RECORDS = 1000
LEVEL = 5
#: A gzip member of no bytes.
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()

FIELDS = (
    "file string, start long, stop long, reason string, record_id string, record_type string, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary"
)


class Broken(ValueError):
    """A check that failed; its text is the reason that is logged. inner: what a member gave before it;
    found, gaps: the records in that, and what lies between them."""

    def __init__(self, reason: str, inner: bytes = b""):
        super().__init__(reason)
        self.inner = inner
        self.found: list[tuple] = []
        self.gaps: list[tuple[int, int, str]] = []


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record: a response with the payload, or a revisit of refers_to without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = [
        f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(uri.split())}"] if uri else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_urn(page_id) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def _members(batches):
    for ids, urls, payloads, sha1s, leads in steps(batches):
        out = []
        for page, url, payload, sha1, lead in zip(ids, urls, payloads, sha1s, leads):
            refers = None if lead is None or lead == page else page_urn(lead)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            out.append(member(record(page_urn(page), url, payload, digest, refers)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row. Of rows with equal payloads that with the largest id is the response.

    Null payloads count as empty; empty payloads are payloads like others; rows that repeat the
    largest id are all responses; a null id revisits, or is a response if none of its payload has an
    id; an empty table writes no record. Payloads of any length are one record; other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    leads = saved(rows.groupBy("sha1").agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "leads")
    (
        rows.join(maybe_broadcast(leads, leads.count()), "sha1", "left").select("page_id", "url", "payload", "sha1", "lead")
        .mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )


# ---------------------------------------------------------------- reading


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The member at a place and where it ends."""
    begin, z, out, step = at, zlib.decompressobj(31), [], 1 << 14
    while not z.eof:
        if at >= len(data):
            raise Broken("truncated member", b"".join(out))
        try:
            out.append(z.decompress(data[at : at + step]))
        except zlib.error as e:
            raise Broken(f"bad member: {e}", _before_failure(data, begin)) from None
        at += step
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def _before_failure(data: bytes, at: int) -> bytes:
    """What a bad member gives up to about the bytes that fail, fed in small steps."""
    z, out = zlib.decompressobj(31), []
    try:
        while at < len(data) and not z.eof:
            out.append(z.decompress(data[at : at + 64]))
            at += 64
    except zlib.error:
        pass
    return b"".join(out)


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place, all checks passed."""
    if not data.startswith(LINE, at):
        raise Broken("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Broken("unended header")
    headers: dict[str, str] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Broken("no content length")
    begin, end = head + 4, head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("record doesn't end where its length says")
    block = data[begin:end]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base32_sha1(block):
        raise Broken("block digest differs")
    return headers, block, end + 4


def fields(headers: dict[str, str], block: bytes) -> tuple:
    """record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload."""
    kind = headers.get("warc-type", "")
    payload = block
    http: dict[bytes, bytes] = {}
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size, digest = int(http.get(b"content-length", b"0") or 0), told
        payload = None
    else:
        size, digest = len(payload), base32_sha1(payload)
        if told and told != digest:
            raise Broken("payload digest differs")
    strip = lambda x: x.strip("<>") if x else None
    return strip(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), size, digest, strip(headers.get("warc-refers-to")), payload


def _records(inner: bytes) -> tuple[list[tuple], list[tuple[int, int, str]]]:
    """Records in inflated bytes, and the gaps between them: after a failed check the search goes on to
    the next version line from which a record passes."""
    found, gaps, at = [], [], 0
    while at < len(inner):
        try:
            headers, block, end = parse_record(inner, at)
            found.append(fields(headers, block))
            at = end
        except Broken as e:
            begin, reason = at, str(e)
            while (at := inner.find(LINE, at + 1)) >= 0:
                try:
                    fields(*parse_record(inner, at)[:2])
                    break
                except Broken:
                    continue
            at = len(inner) if at < 0 else at
            gaps.append((begin, at, reason))
    return found, gaps


def _one(data: bytes, at: int) -> tuple[list[tuple], list[tuple[int, int, str]], int]:
    """Records of the member, or the record, at a place, gaps in the member, and where it ends."""
    if data.startswith(MAGIC, at):
        try:
            inner, end = _inflate(data, at)
        except Broken as e:
            e.found, e.gaps = _records(e.inner)
            raise
        found, gaps = _records(inner)
        if gaps and not found:
            raise Broken(gaps[0][2])
        return found, gaps, end
    headers, block, end = parse_record(data, at)
    return [fields(headers, block)], [], end


def salvage(data: bytes):
    """(start, stop, reason, fields or None): records with no reason, gaps with one, in file order.

    Every byte lies in a record's member, in an empty member, or in a gap. A damaged member gives its
    good records, and a gap for each part that is lost; such a gap names the inflated bytes, and where
    the member doesn't end well it reaches to the next place that passes.
    """
    at, size = 0, len(data)
    while at < size:
        begin = at
        try:
            found, gaps, at = _one(data, at)
            lost = None
        except Broken as e:
            found, gaps, lost, at = e.found, e.gaps if e.found else [], str(e), at + 1
            while at < size:
                tries = [p for p in (data.find(MAGIC, at), data.find(LINE, at)) if p >= 0]
                if not tries:
                    at = size
                    break
                at = min(tries)
                try:
                    _one(data, at)
                    break
                except Broken as other:
                    if other.found:
                        break
                    at += 1
        for f in found:
            yield begin, at, None, f
        for a, b, reason in gaps:
            yield begin, at, f"{reason}, inflated bytes {a} to {b}", None
        if lost:
            yield begin, at, lost, None


def _salvaged(with_payload: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                rows = []
                for start, stop, reason, f in salvage(batch.column(1)[i].as_py()):
                    f = f or (None,) * 7
                    rows.append((name, start, stop, reason, *(f if with_payload else (*f[:6], None))))
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), _TYPES)], names=_NAMES)

    return run


_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in FIELDS.split(", ")]


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (reason null) and quarantined gaps (reason set) of every file under path; see FIELDS.

    Compressed and plain records may be mixed, members may hold any number of records. Without payloads
    the column is null. Empty files give no row; repeated records are rows of their own; a record without
    an id, a URI or a payload has nulls for them; payloads of any length are read whole. A file has to
    fit a task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged(with_payload), FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back: page_id, payload_bytes,
    payload_digest, record_type, refers_to for each record.

    Odd rows are written as write_warc() says; other columns are ignored; no pages give no row.
    """
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/tesserae-{uuid.uuid4().hex}/warc"
    write_warc(pages, path)
    own_later(spark, path)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return read_warc(spark, path, with_payload=False).where("reason is null").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return round_trip(table(spark, sf_dir, "pages"))
