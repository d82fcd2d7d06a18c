import hashlib
import random
import struct
import zlib
from fractions import Fraction

from relforge.llm import mpeg_audio as m


def reference_crc(data):
    """Bit by bit."""
    value = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = value >> 15 ^ byte >> bit & 1
            value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def test_crc():
    rng = random.Random(1)
    for n in (0, 1, 19, 34):
        data = rng.randbytes(n)
        assert m.crc16(data) == reference_crc(data)


def test_round_trip_of_any_bytes():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 936, 937, 938, 5000, 200_000):
        payload = m.payload_of(rng.randbytes(n))
        data = m.write_stream(payload)
        s = m.parse_stream(data)
        assert m.read_payload(data, s) == payload and len(payload) % 64 == 0
        assert s.skipped == s.crc_bad == 0 and s.crc_checked == len(s.headers) + 1
        assert s.table["frames"] == len(s.headers) and s.table["bytes"] == sum(h.length for h in s.headers)
        assert s.duration == Fraction(1152 * len(s.headers), m.RATE)


def frame(word, fill=b"\0", crc=None):
    h = m.header_of(word)
    body = word.to_bytes(4, "big") + (crc or b"") + fill * h.length
    return body[: h.length]


def test_headers_of_all_versions_and_layers():
    assert m.header_of(0xFFFB9064).length == 417 and m.header_of(0xFFFB9264).length == 418  # 128 kbit/s, 44.1 kHz
    h = m.header_of(0xFFF38064)  # MPEG 2 Layer III, 64 kbit/s, 22.05 kHz
    assert (h.version, h.layer, h.rate, h.samples, h.length, h.side) == (2, 3, 22050, 576, 208, 17)
    h = m.header_of(0xFFFF8064)  # MPEG 1 Layer I, 256 kbit/s
    assert (h.layer, h.samples, h.length) == (1, 384, 12 * 256000 // 44100 * 4)
    for bad in (0xFFFBF064, 0xFFFB0064, 0xFFFB9C64, 0xFFEB9064, 0xFFF99064, 0x00000000):
        assert m.header_of(bad) is None


def test_resynchronisation_tags_and_seeking():
    one = frame(0xFFFB9064)
    junk = b"\xff\xfb\x90 not a frame \xff\xff"
    tag = b"ID3\x04\0\0\0\0\0\x0f" + b"TIT2\0\0\0\x05\0\0\0abcd"
    data = junk + tag + one * 3 + b"xx" + one * 2 + b"\xff\xfb" + b"TAG" + bytes(125)
    s = m.parse_stream(data)
    start = len(junk) + len(tag)
    assert s.offsets == [start, start + 417, start + 834, start + 1253, start + 1670]
    assert s.skipped == len(junk) + 2 + 2 and s.tags["TIT2"] == b"\0abcd" and "ID3v1" in s.tags
    assert s.duration == Fraction(5 * 1152, 44100)
    assert m.seek(s, Fraction(0)) == start and m.seek(s, Fraction(1152, 44100)) == start + 417 and m.seek(s, s.duration) is None


def test_variable_bitrate_tables_and_bad_checksums():
    h = m.header_of(0xFFFB9064)
    vbri = frame(0xFFFB9064)
    vbri = vbri[:36] + b"VBRI" + struct.pack(">HHH", 1, 0, 0) + struct.pack(">IIHHHH", 417 * 4, 3, 2, 1, 2, 1) + struct.pack(">HH", 100, 200) + vbri[66:]
    s = m.parse_stream(vbri[: h.length] + frame(0xFFFB9064) * 3)
    assert s.table["kind"] == "VBRI" and s.table["frames"] == 3 and s.table["toc"] == [100, 200] and len(s.headers) == 3
    good = bytearray(m.write_stream(m.payload_of(b"x" * 3000)))
    at = m.parse_stream(bytes(good)).offsets[1]
    good[at + 4] ^= 1
    s = m.parse_stream(bytes(good))
    assert s.crc_bad == 1


def test_empty_and_hopeless_streams():
    for data in (b"", b"\xff" * 500, b"ID3", b"TAG" + bytes(125)):
        s = m.parse_stream(data)
        assert not s.headers and s.duration == 0 and m.read_payload(data, s) is None


def test_columns(spark):
    rows = [(1, "héllo", 0), (2, None, 0), (3, "", 0), (3, "", 0), (None, "a" * 300_000, 0), (5, "b" * 64, 0)]
    got = m.media_features(spark.createDataFrame(rows, "doc_id long, text string, media int")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = m.write_stream(payload)
        r = by[doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert by[2, 0].feature == by[3, 0].feature and "crc=0/" in by[2, 0].feature
    assert m.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_foreign_streams_are_parsed_too(spark):
    rows = [(1, 0, frame(0xFFFB9064) * 4), (2, 0, None)]
    got = {r.doc_id: r for r in m.read_media(spark.createDataFrame([(a, b, bytearray(c) if c else None) for a, b, c in rows], "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].payload is None and got[1].frames == 4 and list(got[1].seek_offsets) == [0, 417, 834, 1251] and (got[1].duration_num, got[1].duration_den) == (128, 1225)
    assert got[2].frames == 0 and got[2].media is None
