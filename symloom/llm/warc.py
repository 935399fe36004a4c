"""WARC archives: segmented records out, reassembled records back.

Writing: a page's payload becomes an HTTP response with chunked framing; of
pages with equal payloads the one with the largest id is a ``response``, the
others are ``revisit`` records that refer to it.  A record block over
``SEGMENT`` bytes is cut: the first part keeps the record's type with segment
number 1, the others are ``continuation`` records with the origin's id; the last
of them states the total length.  Records are gzip members of archives of about
``ARCHIVE`` bytes.

Reading: records are parsed archive by archive.  Segments are grouped by their
origin's id, put in order of their number, checked for gaps and for the total
length, and the HTTP body's chunks are decoded and checked against the payload
digest.  Records that lie whole in one archive are put together there; only the
segments of records that an archive's border breaks are shuffled by origin (a
group is one page's record).

Defined results: a null or empty html is an empty payload, deduplicated like any
other; rows of one id and payload are all responses if that id is the largest;
a null id loses to any other and is a response only where all are null; very
long pages are segmented; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, tune

SEGMENT = 8192
CHUNK = 4096
ARCHIVE = 4 << 20
LEAST = 0  # bytes of a payload that may be revisited
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        n = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(framed[at : at + n])
        at += n + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records(rid: str, url: str | None, payload: bytes, refers: str | None) -> list[bytes]:
    """A page's records: the first, then its continuations."""
    digest = sha1_base32(payload)
    head = {"WARC-Type": "revisit" if refers else "response", "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers}>"}
        return [record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        return [record(head, block)]
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = [record(head | {"WARC-Segment-Number": "1"}, parts[0])]
    for i, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{rid}:{i}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<{rid}>", "WARC-Segment-Number": str(i)}
        if i == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record(more, part))
    return out


def read_records(archive: bytes):
    """``(headers, block)`` of every record; header names in lower case."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)))
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("the archive is cut short")
        yield headers, block


def _page_urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _write(batches):
    part, n, row, out = TaskContext.get().partitionId(), 0, 0, []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([b"".join(out)], pa.binary())], ["part", "archive", "content"])

    for batch in batches:
        for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ref = None if refers is None else _page_urn(refers)
            for raw in records(f"{_page_urn(page_id)}:{part}.{row}", url, html.encode("utf-8", "surrogatepass"), ref):
                out.append(gzip.compress(raw, 3, mtime=0))
                size += len(out[-1])
                if size >= ARCHIVE:
                    yield flush()
                    out, size, n = [], 0, n + 1
            row += 1
    if out:
        yield flush()


def write(pages: DataFrame) -> DataFrame:
    """``(part, archive, content)``: the archives of ``(page_id, url, html)``."""
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.max(F.octet_length("html")).alias("size"))
    marked = rows.join(largest, "digest").select(
        "page_id", "url", "html", F.when((F.col("size") >= LEAST) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers")
    )
    return materialise(marked.mapInArrow(_write, "part int, archive int, content binary"), "warc", "none")


_RECORD = "origin string, number int, total long, kind string, url string, digest string, refers string, block binary"
_OUT = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes of payload that a task holds before it hands rows on.
_HELD = 4 << 20


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _segment(h: dict[str, str], block: bytes) -> tuple:
    """A record as a row of ``_RECORD``."""
    go_on = h["warc-type"] == "continuation"
    total, refers = h.get("warc-segment-total-length"), h.get("warc-refers-to")
    return (
        h["warc-segment-origin-id" if go_on else "warc-record-id"].strip("<>"), int(h.get("warc-segment-number", 0)), None if total is None else int(total),
        h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if refers is None else refers.strip("<>"), block,
    )


def _is_whole(segments: list[tuple]) -> bool:
    """One record without segment number, or all of 1 to the one with the total."""
    numbers = sorted(s[1] for s in segments)
    return numbers == [0] or (numbers == list(range(1, len(numbers) + 1)) and any(s[2] is not None and s[1] == numbers[-1] for s in segments))


def _parse(whole: bool):
    """Of each archive the whole records, put together; or the other segments."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held: dict[str, list[tuple]] = {}
                out, size = [], 0
                for h, block in read_records(content.as_py()):
                    row = _segment(h, block)
                    held.setdefault(row[0], []).append(row)
                    if not (row[1] == 0 or row[2] is not None) or not _is_whole(held[row[0]]):
                        continue
                    segments = held.pop(row[0])
                    if whole:
                        out.append(_put_together(segments))
                        size += len(out[-1][2] or b"")
                        if size >= _HELD:
                            yield _batch(out, _OUT)
                            out, size = [], 0
                for segments in held.values():
                    if whole and _is_whole(segments):  # the last segment came before others
                        out.append(_put_together(segments))
                    elif not whole and not _is_whole(segments):
                        yield _batch(segments, _RECORD)
                if out:
                    yield _batch(out, _OUT)

    return run


def _put_together(segments: list[tuple]) -> tuple:
    first = next((s for s in segments if s[3] != "continuation"), None)
    if first is None:
        raise ValueError(f"{segments[0][0]}: the first segment is missing")
    origin, _, _, kind, url, digest, refers, _ = first
    page, payload, size, ref = assemble(origin, kind, digest, refers, [(s[1], s[2], s[7]) for s in segments])
    return page, url, payload, size, digest, kind, ref


def assemble(origin: str, kind: str, digest: str | None, refers: str | None, segments: list[tuple[int, int | None, bytes]]):
    """``(page_id, payload or None, size, refers_to)`` of a whole record."""
    segments = sorted(segments, key=lambda s: s[0])
    if len(segments) > 1 or segments[0][0]:
        if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
            raise ValueError(f"{origin}: segments are missing")
        total = segments[-1][1]
        if total != sum(len(s[2]) for s in segments):
            raise ValueError(f"{origin}: the segments' length is not the total")
    block = b"".join(s[2] for s in segments)
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])
    page = origin.split(":")[2]
    ref = refers.split(":")[2] if refers else ""
    if kind == "revisit":
        payload, size = None, int(fields[b"content-length"])
    else:
        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        size = len(payload)
        if digest and sha1_base32(payload) != digest:
            raise ValueError(f"{origin}: the payload does not match its digest")
    return int(page) if page else None, payload, size, int(ref) if ref else None


def _join(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield _batch([_put_together([tuple(s[c] for c in ("origin", "number", "total", "kind", "url", "digest", "refers", "block")) for s in r["segments"]])], _OUT)


def read(archives: DataFrame) -> DataFrame:
    """The whole records of archives; ``payload`` is null for revisits."""
    content = archives.select("content")
    broken = content.mapInArrow(_parse(False), _RECORD)
    columns = [x.split()[0] for x in _RECORD.split(", ")]
    groups = broken.groupBy("origin").agg(F.collect_list(F.struct(*columns)).alias("segments")).select("segments")
    return content.mapInArrow(_parse(True), _OUT).union(groups.mapInArrow(_join, _OUT))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(load(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB SQL; a base32 digit is five bits of a group of five hex digits.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CAST(CASE WHEN page_id <> last THEN last END AS BIGINT) AS refers_to
FROM h"""
