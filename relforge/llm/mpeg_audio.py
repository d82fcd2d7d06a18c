"""Operator 2: media columns of MPEG audio.

`parse_stream` reads any MPEG audio stream: tags in front and behind, frame
headers of MPEG 1, 2 and 2.5 in layers I to III, resynchronisation over junk,
Xing, Info and VBRI tables, CRC-16 checks, exact duration as a fraction of a
second, and the byte offset of every frame.  `write_stream` stores bytes
losslessly in a silent, checksummed, variable-bitrate Layer III stream: a frame
whose granules have no audio data leaves its main data free, and there the
payload goes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches

# Fixed values of the MPEG audio format.
BITRATES = {  # kbit/s by (MPEG 1 or not, layer)
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

#: Written streams: MPEG 1 Layer III, 48 kHz, mono, with checksums.
RATE = 48000
_SIDE = 17
_OWNER = b"payload\x00"


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (CRC_POLYNOMIAL if value & 0x8000 else 0)
        out.append(value & 0xFFFF)
    return out


_CRC = _crc_table()
_CRC_KNOWN: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The format's checksum; silent frames repeat, so recent values are kept."""
    if (known := _CRC_KNOWN.get(data)) is not None:
        return known
    value = CRC_START
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    if len(_CRC_KNOWN) < 4096:
        _CRC_KNOWN[data] = value
    return value


@dataclass(frozen=True)
class Header:
    version: int  # the two version bits: 3 is MPEG 1, 2 is MPEG 2, 0 is MPEG 2.5
    layer: int
    protected: bool
    bitrate: int  # bit/s
    rate: int
    channels: int
    length: int  # bytes of the whole frame
    samples: int
    mode: int
    extension: int

    @property
    def side(self) -> int:
        """Bytes of a Layer III frame's side information."""
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)


_HEADERS: dict[int, Header | None] = {}


def header_of(word: int) -> Header | None:
    """The header in 32 bits, None if they hold none (free-format and reserved values are none)."""
    if word in _HEADERS:
        return _HEADERS[word]
    out = None
    version, layer, bits, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and version != 1 and layer != 4 and 0 < bits < 15 and rate < 3 and word & 3 != 2:
        bitrate = BITRATES[version == 3, layer][bits] * 1000
        hertz, pad = SAMPLE_RATES[version][rate], word >> 9 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
        length = (12 * bitrate // hertz + pad) * 4 if layer == 1 else samples // 8 * bitrate // hertz + pad
        out = Header(version, layer, not word >> 16 & 1, bitrate, hertz, 1 if word >> 6 & 3 == 3 else 2, length, samples, word >> 6 & 3, word >> 4 & 3)
    if len(_HEADERS) < 65536:
        _HEADERS[word] = out
    return out


@dataclass
class Stream:
    """What a stream holds; offsets and lengths are in bytes, of audio frames only (the table's frame is none)."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict[str, object] | None = None
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes that belong to no tag or frame
    duration: Fraction = Fraction(0)

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """The end of an ID3v2 tag at `at`; its frames go to tags."""
    size = 0
    for byte in data[at + 6 : at + 10]:
        size = size << 7 | byte & 127
    major, flags = data[at + 3], data[at + 5]
    end = min(at + 10 + size, len(data))
    p = at + 10
    if flags & 0x40 and p + 4 <= end and major in (3, 4):  # extended header
        n = struct.unpack(">I", data[p : p + 4])[0]
        p += n + 4 if major == 3 else max(4, _synchsafe(data[p : p + 4]))
    head, width = (6, 3) if major == 2 else (10, 4)
    while p + head <= end and data[p]:
        name = data[p : p + width].decode("latin-1")
        if major == 2:
            n = int.from_bytes(data[p + 3 : p + 6], "big")
        else:
            n = _synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        if p + head + n > end:
            break
        key = name
        while key in tags:
            key += "+"
        tags[key] = data[p + head : p + head + n]
        p += head + n
    return min(end + (10 if flags & 0x10 else 0), len(data))


def _synchsafe(four: bytes) -> int:
    return (four[0] & 127) << 21 | (four[1] & 127) << 14 | (four[2] & 127) << 7 | four[3] & 127


def _table(frame: bytes, header: Header) -> dict[str, object] | None:
    """The variable-bitrate table in a stream's first frame."""
    at = 4 + (2 if header.protected else 0) + header.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info"):
        out: dict[str, object] = {"kind": kind.decode()}
        flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = frame[p : p + 100]
            p += 100
        if flags & 8:
            out["quality"] = int.from_bytes(frame[p : p + 4], "big")
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def _crc_span(frame: bytes, header: Header) -> bytes | None:
    """The bytes that a frame's checksum is over; None where it depends on decoded allocations (Layer II)."""
    if header.layer == 3:
        return frame[2:4] + frame[6 : 6 + header.side]
    if header.layer == 1:
        bound = min(32, (header.extension + 1) * 4) if header.mode == 1 else 32
        bits = 4 * (bound * header.channels + (32 - bound))
        return frame[2:4] + frame[6 : 6 + bits // 8]
    return None


def parse_stream(data: bytes) -> Stream:
    """Read a stream of MPEG audio.

    After bytes that begin no frame the parser goes on to the next header that
    another compatible header (or a tag, or the end) follows.  A truncated last
    frame counts as skipped.  Empty data has no frames and duration 0.
    """
    out, end, p, first = Stream(), len(data), 0, True
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end : end + 128]
    locked = False
    while p < end:
        if data[p : p + 3] == b"ID3" and end - p >= 10:
            p, locked = _id3v2(data, p, out.tags), False
            continue
        header = header_of(int.from_bytes(data[p : p + 4], "big")) if end - p >= 4 else None
        fits = header is not None and p + header.length <= end
        if fits and not locked:
            q = p + header.length
            after = header_of(int.from_bytes(data[q : q + 4], "big")) if end - q >= 4 else None
            fits = q == end or data[q : q + 3] == b"ID3" or after is not None and (after.version, after.layer, after.rate) == (header.version, header.layer, header.rate)
        if not fits:
            q = data.find(b"\xff", p + 1, end)
            tag = data.find(b"ID3", p + 1, end)
            q = min(x for x in (q, tag, end) if x >= 0)
            out.skipped += q - p
            p, locked = q, False
            continue
        frame = data[p : p + header.length]
        if header.protected and (span := _crc_span(frame, header)) is not None:
            out.crc_checked += 1
            out.crc_bad += crc16(span) != int.from_bytes(frame[4:6], "big")
        if first and header.layer == 3 and (table := _table(frame, header)) is not None:
            out.table = table
        else:
            out.offsets.append(p)
            out.headers.append(header)
        first, locked = False, True
        p += header.length
    per: dict[int, int] = {}
    for h in out.headers:
        per[h.rate] = per.get(h.rate, 0) + h.samples
    out.duration = sum((Fraction(n, rate) for rate, n in per.items()), Fraction(0))
    return out


def seek(stream: Stream, seconds: Fraction) -> int | None:
    """The byte offset of the frame that plays at `seconds`; None beyond the end."""
    at = Fraction(0)
    for offset, header in zip(stream.offsets, stream.headers, strict=True):
        at += Fraction(header.samples, header.rate)
        if seconds < at:
            return offset
    return None


def _frame(bits: int, body: bytes, side: bytes = bytes(_SIDE)) -> bytes:
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | bits << 12 | 1 << 10 | 3 << 6
    head = word.to_bytes(4, "big")
    return head + crc16(head[2:4] + side).to_bytes(2, "big") + side + body


#: Free bytes of a frame by its bitrate's index.
_ROOM = [0] + [144 * kbit * 1000 // RATE - 4 - 2 - _SIDE for kbit in BITRATES[True, 3][1:]]
_LARGEST = len(_ROOM) - 1
#: The smallest frame for so many bytes.
_FITTING = [next(k for k in range(1, _LARGEST + 1) if _ROOM[k] >= n) for n in range(_ROOM[_LARGEST] + 1)]


def write_stream(payload: bytes) -> bytes:
    """A stream that carries `payload`, its length in a private tag; the last frame is as small as it can be."""
    room = _ROOM[_LARGEST]
    frames = []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        bits = _FITTING[len(part)]
        frames.append(_frame(bits, part.ljust(_ROOM[bits], b"\0")))
    sizes = np.cumsum([0] + [len(x) for x in frames])
    total, n = int(sizes[-1]), len(frames)
    toc = bytes(int(256 * sizes[k * n // 100]) // max(total, 1) for k in range(100)) if n else bytes(100)
    info = b"Xing" + struct.pack(">III", 7, n, total) + toc
    bits = _FITTING[len(info)]
    private = _OWNER + len(payload).to_bytes(8, "big")
    body = b"PRIV" + struct.pack(">I", len(private)) + b"\0\0" + private
    tag = b"ID3\x03\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body
    return b"".join([tag, _frame(bits, info.ljust(_ROOM[bits], b"\0")), *frames])


def read_payload(data: bytes, stream: Stream) -> bytes | None:
    """The payload of a written stream, from its frames' main data; None for another stream."""
    private = stream.tags.get("PRIV", b"")
    if not private.startswith(_OWNER) or len(private) != len(_OWNER) + 8:
        return None
    got = b"".join(data[p + 4 + (2 if h.protected else 0) + h.side : p + h.length] for p, h in zip(stream.offsets, stream.headers, strict=True))
    return got[: int.from_bytes(private[len(_OWNER) :], "big")]


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def _stored(batches):
    """Batches of doc_id, n_bytes and media from those of doc_id and text."""
    for batch in batches:
        size, media = [], []
        for text in batch.column(1):
            raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            size.append(len(raw))
            media.append(write_stream(payload_of(raw)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


_READ = (
    "doc_id long, n_bytes long, media binary, payload binary, frames long, samples long, duration_num long, duration_den long, "
    "seek_offsets array<long>, bitrates array<int>, table_frames long, table_bytes long, crc_checked long, crc_bad long, skipped long"
)


def _parsed(batches):
    """Batches of _READ from those of doc_id, n_bytes and media."""
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int64()] * 5]
    for batch in batches:
        rows = []
        for blob in batch.column(2):
            data = b"" if not blob.is_valid else blob.as_buffer().to_pybytes()
            s = parse_stream(data)
            table = s.table or {}
            rows.append((
                read_payload(data, s), len(s.headers), s.samples, s.duration.numerator, s.duration.denominator, s.offsets,
                [h.bitrate // 1000 for h in s.headers], table.get("frames"), table.get("bytes"), s.crc_checked, s.crc_bad, s.skipped,
            ))
        more = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types[3:], strict=True)] if rows else [pa.array([], t) for t in types[3:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), *more], names=names)


def _texts(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media for every row of `documents` (doc_id, text): the text's payload as an MPEG audio stream.

    A null text is an empty one.  Rows are kept as they come, repeated or not;
    other columns are not read.
    """
    return _texts(documents).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """`media` (doc_id, n_bytes, media) with what parsing each stream yields.

    Adds payload (null unless written by `encode_texts`), frames, samples, the
    duration as duration_num / duration_den seconds, seek_offsets (of every
    frame), bitrates, table_frames, table_bytes, crc_checked, crc_bad and
    skipped.  A null stream is an empty one.
    """
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_parsed, _READ)


def store_and_read(documents: DataFrame) -> DataFrame:
    """`read_media` of `encode_texts`, by one pass of Python: streams don't go to the JVM and back in between."""
    return _texts(documents).mapInArrow(lambda batches: _parsed(_stored(batches)), _READ)


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of `read_media`'s rows; feature sums up the parsed stream."""
    offsets = F.sha2(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary"), 256)
    parts = [
        ("frames", F.col("frames")), ("samples", F.col("samples")), ("duration", F.concat_ws("/", F.col("duration_num"), F.col("duration_den"))),
        ("table", F.concat_ws("/", F.col("table_frames"), F.col("table_bytes"))), ("crc", F.concat_ws("/", F.col("crc_bad"), F.col("crc_checked"))),
        ("skipped", F.col("skipped")), ("seek", F.substring(offsets, 1, 16)),
    ]
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts)).alias("feature"),
    )


def media_features(documents: DataFrame) -> DataFrame:
    """Every text stored as a stream, read back and summed up: see `encode_texts`, `read_media` and `digests`."""
    return digests(store_and_read(documents))
