"""MPEG audio columns: writing, resynchronising, tags, checksums, seek tables.

``parse`` reads any MPEG-1/2/2.5 audio stream: it skips ID3v2 tags at the begin
and ID3v1 at the end, finds frames (again after damage: a header counts only if
another one follows where it says), reads the Xing/Info and VBRI tables of
variable-bitrate files, verifies the frames' checksums (layers I and III; the
protected part of layer II is not delimited by the header, so those count as
unverified) and the table's own, and gives the exact duration as samples over
the sample rate and the offset of every frame.

``wrap`` stores a payload without loss: frames of silence (no part of a granule
is coded) whose ancillary data, which decoders skip, carry the payload bytes.
The stream has an ID3v2 tag with the payload's length, a variable-bitrate table
with its own checksum, protected frames, and an ID3v1 tag.

Defined results: a null or empty text has a payload of 64 zero bytes; equal
texts give equal streams; a null id is kept; very long texts count whole; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, materialise, texts, tune

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by (low sampling, layer), Hz by version.
BITRATES = {
    (False, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}
PRIVATE = b"symloom.payload\0"
VENDOR = b"SYML1.000"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The frame checksum (polynomial 0x8005, highest bit first)."""
    for x in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ x]
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 1.0 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    if raw not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[raw] = _header(raw)
    return _headers[raw]


def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    low = version != 1.0
    kbps, hz, pad = BITRATES[low, layer][index], RATES[version][rate], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
    length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    return Header(version, layer, not raw[1] & 1, kbps, hz, raw[3] >> 6 == 3, length, samples)


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    skipped: int = 0  # bytes between frames that belong to nothing
    crc_good: int = 0
    crc_bad: int = 0
    crc_none: int = 0

    def duration(self) -> tuple[int, int]:
        """Seconds as an exact fraction, encoder delay and padding taken off."""
        t = self.table or {}
        return max(0, self.samples - t.get("delay", 0) - t.get("padding", 0)), self.rate or 1


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """End of the tag at ``at``; its frames go to ``out.tags``."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags, size = data[at + 3], data[at + 5], safe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    p = at + 10
    if flags & 0x40 and p + 4 <= end:
        p += safe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    while p + 10 <= end and data[p]:
        n = safe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        out.tags[data[p : p + 4].decode("latin-1")] = data[p + 10 : min(end, p + 10 + n)]
        p += 10 + n
    return min(len(data), end + (10 if flags & 0x10 else 0))


def _table(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in a stream's first frame."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out, flags, p = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = frame[p : p + 100]
            p += 100
        if flags & 8:
            p += 4
        if len(frame) >= p + 36 and frame[p : p + 4].strip(b"\0"):
            d = int.from_bytes(frame[p + 21 : p + 24], "big")
            out |= {"delay": d >> 12, "padding": d & 0xFFF, "crc_ok": crc16(frame[: p + 34], 0) == int.from_bytes(frame[p + 34 : p + 36], "big")}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        out = {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
        count, scale, size, each = struct.unpack(">4H", frame[54:62].ljust(8, b"\0"))
        entries = frame[62 : 62 + count * size]
        if size and len(entries) == count * size:
            steps = (scale * int.from_bytes(entries[i : i + size], "big") for i in range(0, len(entries), size))
            out |= {"every": each, "seek": list(accumulate(steps))}  # bytes to the end of each entry's frames
        return out
    return None


_good: set[bytes] = set()


def _checks(frame: bytes, h: Header) -> bool | None:
    if not h.protected or h.layer == 2:
        return None
    if h.layer == 3:
        n = h.side
    else:  # layer I: 4 bits of allocation for each subband and channel
        bound = 32 if h.mono or frame[3] >> 6 != 1 else 4 * ((frame[3] >> 4 & 3) + 1)
        n = (4 * (32 if h.mono else bound * 2 + 32 - bound)) // 8
    if len(frame) < 6 + n:
        return False
    part = frame[2 : 6 + n]  # header half, checksum, protected bytes
    if part in _good:
        return True
    ok = crc16(part[:2] + part[4:]) == int.from_bytes(part[2:4], "big")
    if ok and len(_good) < 4096:
        _good.add(part)
    return ok


def parse(data: bytes) -> Stream:
    out = Stream()
    at, end = 0, len(data)
    while (nxt := _id3v2(data, at, out)) > at:
        at = nxt
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["TAG"] = data[end : end + 128]
    locked = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and h.length >= 4 and not locked:
            after = at + h.length
            nxt = header(data[after : after + 4]) if after + 4 <= end else None
            if not (after == end or (nxt and nxt.rate == h.rate and nxt.layer == h.layer and nxt.version == h.version)):
                h = None
        if not h or at + h.length > end or (out.rate and h.rate != out.rate):
            locked = False
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        frame = data[at : at + h.length]
        if not out.rate:
            out.rate = h.rate
            out.table = _table(frame, h) if h.layer == 3 else None
            if out.table:
                at += h.length
                locked = True
                continue
        locked = True
        ok = _checks(frame, h)
        out.crc_none += ok is None
        out.crc_good += ok is True
        out.crc_bad += ok is False
        out.offsets.append(at)
        out.lengths.append(h.length)
        out.samples += h.samples
        at += h.length
    out.skipped += max(0, end - at)
    return out


# ---- carrying a payload ----------------------------------------------------

_HZ, _SIDE = 32000, 17  # MPEG-1 layer III, mono
_OVER = 4 + 2 + _SIDE
#: Room for payload by bitrate index, and the protected begin of such a frame.
_ROOM = {i: 144 * BITRATES[False, 3][i] * 1000 // _HZ - _OVER for i in range(1, 15)}


def _begin(index: int) -> bytes:
    half = bytes([index << 4 | 2 << 2, 0xC0])
    side = bytes(_SIDE)
    return b"\xff\xfa" + half + crc16(half + side).to_bytes(2, "big") + side


_BEGIN = {i: _begin(i) for i in _ROOM}


def _vbr_frame(lengths: list[int]) -> bytes:
    """The table frame, for the audio frames' lengths."""
    size = 144 * 40 * 1000 // _HZ  # 40 kbit/s: 180 bytes
    head = b"\xff\xfb" + bytes([2 << 4 | 2 << 2, 0xC0]) + bytes(_SIDE)
    total, ends, at = size + sum(lengths), [], size
    for n in lengths:
        ends.append(at)
        at += n
    toc = bytes(min(255, 256 * ends[min(len(ends) - 1, i * len(ends) // 100)] // total) if ends else 0 for i in range(100))
    body = b"Xing" + struct.pack(">III", 15, len(lengths), total) + toc + (0).to_bytes(4, "big")
    body += VENDOR + bytes(12) + (0).to_bytes(3, "big") + bytes(4) + struct.pack(">I", total) + bytes(2)
    frame = head + body
    return (frame + crc16(frame, 0).to_bytes(2, "big")).ljust(size, b"\0")


def wrap(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries the payload; ``n_bytes`` of it are not padding."""
    full = _ROOM[14]
    frames = [_BEGIN[14] + payload[i : i + full] for i in range(0, len(payload) - len(payload) % full, full)]
    rest = payload[len(frames) * full :]
    if rest:
        index = next(i for i in sorted(_ROOM) if _ROOM[i] >= len(rest))
        frames.append(_BEGIN[index] + rest.ljust(_ROOM[index], b"\0"))
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    body = PRIVATE + struct.pack(">QQ", n_bytes, len(payload))
    tag = b"PRIV" + safe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + safe(len(tag)) + tag + _vbr_frame([len(f) for f in frames]) + b"".join(frames) + b"TAG".ljust(128, b"\0")


def unwrap(data: bytes, s: Stream | None = None) -> tuple[bytes, int]:
    """Payload and its unpadded length."""
    s = s or parse(data)
    tag = s.tags.get("PRIV", b"")
    if not tag.startswith(PRIVATE):
        raise ValueError("the stream carries no payload")
    n, size = struct.unpack(">QQ", tag[len(PRIVATE) :])
    body = b"".join(data[a + _OVER : a + n] for a, n in zip(s.offsets, s.lengths, strict=True))
    if len(body) < size:
        raise ValueError("frames are missing")
    return body[:size], n


def pad(raw: bytes, to: int = 64) -> bytes:
    return raw + bytes(max(to, -(-len(raw) // to) * to) - len(raw))


def describe(s: Stream) -> str:
    """The features of a stream, seek offsets by their checksum."""
    num, den = s.duration()
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}Q", *s.offsets))
    table = f"{s.table['kind']}:{s.table.get('frames', 0)}:{int(s.table.get('crc_ok', False))}" if s.table else "none"
    return f"mpeg;frames={len(s.offsets)};samples={num};rate={den};table={table};crc={s.crc_good}/{s.crc_bad}/{s.crc_none};skipped={s.skipped};seek={seek:08x}"


def _wrap(batches):
    for batch in batches:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for lo in range(0, len(raw), 128):
            part = raw[lo : lo + 128]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array([wrap(pad(x), len(x)) for x in part], pa.binary())], ["doc_id", "media"])


def media(docs: DataFrame) -> DataFrame:
    """``(doc_id, media)``: each text as a stream."""
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(_wrap, "doc_id long, media binary")


FEATURES = "samples long, rate long, frames long, offsets array<bigint>, crc_good long, crc_bad long, crc_none long, skipped long"


def _feature_row(s: Stream) -> tuple:
    """Exact duration (samples over rate), frame offsets, checksums."""
    return (*s.duration(), len(s.offsets), s.offsets, s.crc_good, s.crc_bad, s.crc_none, s.skipped)


def _batch(ids: pa.Array, rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in fields.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)]], ["doc_id", *names])


def _features(batches):
    for batch in batches:
        yield _batch(batch.column(0), [_feature_row(parse(blob.as_py())) for blob in batch.column(1)], FEATURES)


def features(stored: DataFrame) -> DataFrame:
    """Duration (samples over rate) and frame offsets of any ``(doc_id, media)``."""
    return stored.select("doc_id", "media").mapInArrow(_features, f"doc_id long, {FEATURES}")


_PAYLOAD = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _report(batches):
    for batch in batches:
        rows = []
        for blob in batch.column(1):
            data = blob.as_py()
            s = parse(data)
            payload, n = unwrap(data, s)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(s), *_feature_row(s)))
        yield _batch(batch.column(0), rows, f"{_PAYLOAD}, {FEATURES}")


def report(stored: DataFrame) -> DataFrame:
    """The payloads and features of stored ``(doc_id, media)`` written by ``media``."""
    return stored.select("doc_id", "media").mapInArrow(_report, f"doc_id long, {_PAYLOAD}, {FEATURES}")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(media(load(spark, sf_dir, "documents")), "media")
    return materialise(report(stored), "media-features")  # durations and offsets are stored
