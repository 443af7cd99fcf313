"""Media columns: MPEG audio streams with tags, checksums, exact durations and frame seek offsets.

Bytes are stored losslessly as ancillary data of MPEG-1 layer III frames: 224 kbit/s at 48 kHz gives frames of 672 bytes, of which header, checksum and an all-zero side
information take 38 and the payload 576. The side information says that the frames hold no main data, so that a player decodes silence and skips the rest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import in_parts, table

UNIT = 576
PAD = b"\xff"

_RATES = {  # kbit/s by (version 1, layer)
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Header(NamedTuple):
    version: int  # the two bits: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer, rate, hz = b >> 3 & 3, 4 - (b >> 1 & 3), c >> 4, c >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or d & 3 == 2:
        return None
    kbps, hertz, pad = _RATES[version == 3, layer][rate], _HERTZ[version][hz], c >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    return Header(version, layer, not b & 1, kbps, hertz, d >> 6 == 3, length, samples)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        n <<= 8
        for _ in range(8):
            n = (n << 1 ^ 0x8005 if n & 0x8000 else n << 1) & 0xFFFF
        out.append(n)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ b]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """Of the first bits of data."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        top = crc >> 15 ^ data[k // 8] >> (7 - k % 8) & 1
        crc = (crc << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return crc


def _allocation_bits(h: Header) -> list[int]:
    """Bits of the bit allocation of each subband that a layer I or II frame has."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    rate = h.kbps // (1 if h.mono else 2)
    if rate <= 48:
        return [4] * 2 + [3] * (10 if h.hertz == 32000 else 6)
    wide = rate >= 96 and h.hertz != 48000
    return [4] * 11 + [3] * 12 + [2] * (7 if wide else 4)


def guarded(data: bytes, at: int, h: Header) -> tuple[bytes, int]:
    """What a frame's checksum guards, as bytes and the number of bits: half the header, then layer III's side information, layer I's bit allocation, or layer II's bit
    allocation and scale factor selection."""
    body = at + 6
    if h.layer == 3:
        return data[at + 2 : at + 4] + data[body : body + h.side], 16 + 8 * h.side
    widths, mode = _allocation_bits(h), data[at + 3]
    channels = 1 if h.mono else 2
    bound = 4 * ((mode >> 4 & 3) + 1) if mode >> 6 == 1 else 32  # joint stereo: subbands from here on share their allocation
    bits = int.from_bytes(data[body : body + 64].ljust(64, b"\0"), "big")
    place, used = 0, 0
    for band, width in enumerate(widths):
        own = channels if band < bound else 1
        for _ in range(own):
            if bits >> (512 - place - width) & ((1 << width) - 1):
                used += 1 if band < bound else channels
            place += width
    n = place + (2 * used if h.layer == 2 else 0)
    return data[at + 2 : at + 4] + data[body : body + -(-n // 8)], 16 + n


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


_HEAD = bytes((0xFF, 0xFA, 0xC4, 0x00))  # MPEG-1 layer III with checksum, 224 kbit/s, 48 kHz, stereo
_SIDE = bytes(32)
_START = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + _SIDE)) + _SIDE
_FRAME = 672


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A stream with an ID3v2 tag that holds n_bytes, an Info frame with frame count, byte count and seek table, and a frame for each UNIT bytes of payload."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload is no positive multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    text = b"\x03n_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag
    size = (n + 1) * _FRAME
    toc = bytes(min(255, 256 * (_FRAME + i * n // 100 * _FRAME) // size) for i in range(100))
    info = _START + b"Info" + struct.pack(">III", 7, n, size) + toc
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, : len(_START)] = np.frombuffer(_START, np.uint8)
    frames[:, len(_START) : len(_START) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + info.ljust(_FRAME, b"\0") + frames.tobytes()


class Stream(NamedTuple):
    tags: dict[str, str]
    info: dict[str, int] | None  # frames, bytes, method of the variable-bitrate table
    toc: list[int]  # of Xing and Info hundredths of the bytes in 256ths, of VBRI bytes between seek points
    offsets: list[int]  # of each audio frame
    samples: int
    hertz: int
    kbps: list[int]  # the different rates
    checksums: tuple[int, int]  # right, wrong
    skipped: int  # bytes that belong to no frame or tag


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads text frames of versions 2.2 to 2.4; returns where the tag with its footer ends, or at if there is none."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or max(data[at + 6 : at + 10]) > 127:
        return at
    safe = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    major, flags, end = data[at + 3], data[at + 5], min(len(data), at + 10 + safe(data[at + 6 : at + 10]))
    body = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p, name, size = 0, 4 if major > 2 else 3, 10 if major > 2 else 6
    if flags & 0x40 and len(body) >= 4 and major > 2:  # an extended header, whose size counts itself in 2.4 only
        p = safe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    while p + size <= len(body) and body[p]:
        key, number = body[p : p + name].decode("latin-1"), body[p + name : p + 2 * name]
        n = safe(number) if major == 4 else int.from_bytes(number, "big")
        value = body[p + size : p + size + n]
        if key[0] == "T" and value:
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(value[0], 3)], "replace").strip("\0")
            first, _, rest = text.partition("\0")
            tags.update({f"TXXX:{first}": rest} if key in ("TXXX", "TXX") else {key: text})
        p += size + n
    return min(len(data), end + (10 if major == 4 and flags & 0x10 else 0))


def parse(data: bytes) -> Stream:
    """Walks tags and frames. A frame is a header that is followed by another like it, a tag or the end, or that stands where one was due; else the next place is tried."""
    tags: dict[str, str] = {}
    info, toc, offsets, samples, hertz, rates, right, wrong, skipped = None, [], [], 0, 0, set(), 0, 0, 0
    end = len(data)
    tail = end - 128 if data[-128:-125] == b"TAG" else end  # an ID3v1 tag, unless a frame runs through that place

    def id3v1() -> dict[str, str]:
        return {k: v for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)) if (v := data[tail + a : tail + b].split(b"\0")[0].decode("latin-1").strip())}
    at, first, sure, leads = 0, True, False, False
    last: Header | None = None
    checked: dict[tuple[bytes, int], int] = {}
    known: dict[bytes, Header | None] = {}

    def seen(place: int) -> Header | None:
        key = data[place : place + 4]
        if key not in known:
            known[key] = header(data, place)
        return known[key]

    def like(a: Header | None, b: Header | None) -> bool:
        return a is not None and b is not None and a[:2] == b[:2] and a.hertz == b.hertz

    while at < end:
        if (after := _id3v2(data, at, tags)) > at:
            at = after
            continue
        if at == tail:
            tags |= id3v1()
            break
        h = seen(at)
        if h and (n := at + h.length) <= end:
            leads = n == end or like(seen(n), h) or data[n : n + 3] in (b"ID3", b"TAG")
            if not leads and (at < tail < n or not (sure and like(h, last))):  # a header alone may be chance; where one was due, damage may follow
                h = None
        if not h or at + h.length > end:
            stop = tail if at < tail else end
            sync = data.find(b"\xff", at + 1, stop)
            skipped += (sync if sync >= 0 else stop) - at
            at, sure = (sync if sync >= 0 else stop), False
            continue
        body = at + 4 + 2 * h.protected
        if h.protected:
            part = guarded(data, at, h)
            if part not in checked:
                checked[part] = crc16_bits(*part)
            ok = checked[part] == int.from_bytes(data[at + 4 : at + 6], "big")
            right, wrong = right + ok, wrong + (not ok)
        mark = data[body + h.side : body + h.side + 4]
        vbri = data[at + 36 : at + 40] == b"VBRI"
        if first and h.layer == 3 and (mark in (b"Xing", b"Info") or vbri):
            p = body + h.side + 8
            if vbri:
                info = {"bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
                entries, scale, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (54, 56, 58))
                toc = [scale * int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width], "big") for k in range(entries) if at + 62 + (k + 1) * width <= at + h.length]
            else:
                flags, info = int.from_bytes(data[p - 4 : p], "big"), {}
                for bit, name in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        info[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 4:
                    toc = list(data[p : p + 100])
        else:
            offsets.append(at)
            samples, hertz = samples + h.samples, h.hertz
            rates.add(h.kbps)
        first, sure, last, at = False, leads, h, at + h.length
    return Stream(tags, info, toc, offsets, samples, hertz, sorted(rates), (right, wrong), skipped)


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that encode() stored."""
    if not stream.offsets:
        return b""
    a, step = stream.offsets[0], _FRAME
    if stream.offsets[-1] == a + step * (len(stream.offsets) - 1):  # without gaps
        frames = np.frombuffer(data, np.uint8, step * len(stream.offsets), a).reshape(-1, step)
        return frames[:, len(_START) : len(_START) + UNIT].tobytes()
    return b"".join(data[o + len(_START) : o + len(_START) + UNIT] for o in stream.offsets)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


MEDIA = "doc_id long, media binary"


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media, the document's stream. A null text counts as empty; other columns are left out; every row gives one row, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_parts(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([encode(*padded(x.as_py())) for x in rows.column(1)], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MEDIA)


FEATURES = "doc_id long, duration_s double, n_frames long, hertz int, kbps array<int>, checksums_right long, checksums_wrong long, skipped_bytes long, tags map<string,string>, seek_offsets array<long>, table_frames long, table_bytes long, table_seek array<long>"


def describe(media: DataFrame) -> DataFrame:
    """Of each stream (doc_id, media): exact duration, frames, checksums, tags, the offset of every frame, and what its variable-bitrate table says (null, and no seek points,
    without one). Null, empty or broken media have no frames and duration 0; repeated rows and null ids each keep their row; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_parts(batches):
            out = []
            for doc_id, x in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                s = parse(x.as_py() or b"")
                out.append((doc_id, s.samples / s.hertz if s.hertz else 0.0, len(s.offsets), s.hertz, s.kbps, *s.checksums, s.skipped, list(s.tags.items()), s.offsets, (s.info or {}).get("frames"), (s.info or {}).get("bytes"), s.toc))
            types = [pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, FEATURES)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stream back and digests what it holds; a row per row of docs.

    A null text counts as an empty one, whose stream is one frame of padding; texts are stored whole, however long. Repeated rows and null ids each keep their row; an empty
    table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for rows in in_parts(batches):
            out = []
            for doc_id, x in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                media = encode(*padded(x.as_py()))
                s = parse(media)
                payload = payload_of(media, s)
                feature = f"frames={len(s.offsets)};samples={s.samples};hertz={s.hertz};kbps={','.join(map(str, s.kbps))};checksums={s.checksums[0]}/{s.checksums[1]};seek={s.offsets[0]}-{s.offsets[-1]};skipped={s.skipped}"
                out.append((doc_id, int(s.tags["TXXX:n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same streams as hexadecimal text: tag, table frame, and a frame for each UNIT bytes of the payload."""
    start = _START.hex().upper()
    size = f"(({_FRAME} * (n + 1))::BIGINT)"
    toc = f"list_aggregate(list_transform(range(100), lambda i: printf('%02X', least(255, 256 * ({_FRAME} + i * n // 100 * {_FRAME}) // {size}))), 'string_agg', '')"
    safe = lambda e: "||".join(f"printf('%02X', ({e}) >> {s} & 127)" for s in (21, 14, 7, 0))
    text = f"'{(chr(3) + 'n_bytes' + chr(0)).encode().hex().upper()}' || hex(encode(n_bytes::VARCHAR))"
    body = f"'{b'TXXX'.hex().upper()}' || {safe('(length(v) // 2)')} || '0000' || v"
    info = f"'{start}' || '{b'Info'.hex().upper()}' || printf('%08X%08X%08X', 7, n, {size}) || {toc}"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(32), lambda i: ('0x' || p[length(p) - 64 + 2 * i + 1:length(p) - 64 + 2 * i + 2])::BIGINT)), lambda s, x: xor(list_extract(CAST({[_crc32(n) for n in range(256)]} AS BIGINT[]), (xor(s, x) & 255) + 1), s >> 8)), 4294967295::BIGINT)"
    return f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
payloads AS (SELECT doc_id, n_bytes, n, h || repeat('FF', n * {UNIT} - n_bytes) AS p, {text} AS v FROM (SELECT *, greatest(1, (n_bytes + {UNIT - 1}) // {UNIT})::BIGINT AS n FROM texts)),
tagged AS (SELECT *, {body} AS b FROM payloads),
streams AS (SELECT doc_id, n_bytes, n, p, length(b) // 2 AS tag, unhex('{b"ID3".hex().upper()}040000' || {safe("(length(b) // 2)")} || b || rpad({info}, {2 * _FRAME}, '0') ||
  list_aggregate(list_transform(range(n), lambda i: rpad('{start}' || p[{2 * UNIT} * i + 1:{2 * UNIT} * (i + 1)], {2 * _FRAME}, '0')), 'string_agg', '')) AS m FROM tagged)
SELECT doc_id, n_bytes, n * {UNIT} AS payload_bytes, sha256(unhex(p)) AS payload_sha256, {crc} AS tail_crc32, octet_length(m)::BIGINT AS media_bytes, sha256(m) AS media_sha256,
  'frames=' || n || ';samples=' || 1152 * n || ';hertz=48000;kbps=224;checksums=' || n + 1 || '/0;seek=' || tag + 10 + {_FRAME} || '-' || tag + 10 + {_FRAME} * n || ';skipped=0' AS feature FROM streams"""


def _crc32(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
    return n


ORACLE_SQL = _oracle()
