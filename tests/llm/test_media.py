from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

from plumbline.llm import media
from plumbline.llm.queries import op7_media


def png():
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack(
        "<HHBBB", 1, 1, 128, 0, 0
    ) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">H", 11) + b"\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0\x3f\0" + b"ab\xff\x00cd" + b"\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(bytes(range(64)))
    return out.getvalue()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def pdf(note=b""):
    body = b"%PDF-1.4\n1 0 obj<<" + note + b">>endobj\n"
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer<</Size 1>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"


def updated(raw):
    """A PDF with a second section behind its first end."""
    return raw + b"\n2 0 obj<<>>endobj\nxref\n0 1\ntrailer<</Prev 9>>\nstartxref\n" + str(len(raw) + 19).encode() + b"\n%%EOF"


def crc(data, polynomial, bits):
    value = 0
    for byte in data:
        value ^= byte << bits - 8
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> bits - 1 & 1 else 0)) & (1 << bits) - 1
    return value


def flac(frames=3, totals=True):
    out = b""
    for n in range(frames):
        head = bytes([0xFF, 0xF8, 0x18, 0x08, n])  # 192 samples of 16 bits, mono
        frame = head + bytes([crc(head, 7, 8)]) + b"\0" + struct.pack(">H", 77 + n)
        out += frame + struct.pack(">H", crc(frame, 0x8005, 16))
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((8000 << 44) | (15 << 36) | (192 * frames if totals else 0)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\0\0\x22" + info + out


def mp4():
    box = lambda kind, data: struct.pack(">I", 8 + len(data)) + kind + data
    return box(b"ftyp", b"isom\0\0\0\1") + box(b"moov", box(b"mvhd", b"x" * 20)) + struct.pack(">I4sQ", 1, b"mdat", 16 + 9) + b"123456789"


def mp3():
    frame = b"\xff\xfb\x90\x00"  # 128 kbit/s, 44.1 kHz: 417 bytes
    return b"ID3\x03\0\0\0\0\0\x05hello" + (frame + bytes(413)) * 4 + b"TAG" + bytes(125)


def tiff():
    fields = [(256, 3, 1, 1), (273, 4, 1, 8 + 2 + 12 * 3 + 4), (279, 4, 1, 6)]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0) + b"pixels"


def webm():
    doctype = b"\x42\x82\x84webm"
    return b"\x1a\x45\xdf\xa3" + bytes([0x80 | len(doctype)]) + doctype + b"\x18\x53\x80\x67" + b"\x40\x05" + b"12345"


def aiff():
    return b"FORM" + struct.pack(">I", 4 + 8 + 18) + b"AIFF" + b"COMM" + struct.pack(">I", 18) + bytes(18)


ALL = {
    "image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "image/tiff": tiff(), "audio/wav": wav(), "audio/flac": flac(),
    "audio/mpeg": mp3(), "audio/aiff": aiff(), "video/mp4": mp4(), "video/x-matroska": webm(), "application/zip": zipped(),
    "application/gzip": gzip.compress(b"hello" * 50), "application/pdf": pdf(),
}


def test_types_lengths_truncation_and_carving(spark):
    sniffer = media.Sniffer()
    for kind, raw in ALL.items():
        assert media.own_type(raw, sniffer.media(raw)) == kind
        for cut in (len(raw) - 1, len(raw) // 2, 5):
            assert media.own_type(raw[:cut], sniffer.media(raw[:cut])) is None, (kind, cut)
        inside = b"some text BM GIF89a " + raw + b" and more"
        assert [(m.offset, m.length, m.kind) for m in sniffer.media(inside)] == [(20, len(raw), kind)]
    rows = [
        (1, ALL["image/png"], "image/jpeg"), (2, ALL["audio/wav"], "audio/wav"), (3, b"RIFF nothing", "audio/wav"), (4, None, "image/png"),
        (5, b"plain", "text/plain"), (6, ALL["image/gif"] + ALL["image/png"], "image/gif"), (7, b"", None)
    ]
    got = {r.id: r for r in media.sniffed(spark.createDataFrame(rows, "id long, value binary, declared string"), "value", "declared", ["id"]).collect()}
    assert [(got[i].media_type, got[i].corrected) for i in range(1, 8)] == [
        ("image/png", True), ("audio/wav", False), ("unknown", True), ("empty", True), ("text/plain", False), ("unknown", True),
        ("empty", True)
    ]
    assert [m.type for m in got[6].media] == ["image/gif", "image/png"]


def test_random_bytes_are_nothing():
    rng, sniffer = random.Random(4), media.Sniffer()
    for _ in range(300):
        magic = rng.choice(media.FORMATS)[0]
        assert sniffer.media(rng.randbytes(rng.randint(0, 50)) + magic + rng.randbytes(rng.randint(0, 200))) == []


def test_payload_round_trip(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "😀 BM GIF89a RIFF\0\1", "w " * 100_000]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(1, "", "q")], "doc_id long, text string, media string")
    for r in media.texts_as_media(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(want)
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert r.media_type == "audio/wav" and r.embedded == 0
    assert media.texts_as_media(df.where("false")).count() == 0


def test_neighbours_keep_their_lengths():
    sniffer = media.Sniffer()
    for one in (pdf(), updated(pdf()), flac(), flac(5, totals=False), mp3(), mp4()):
        raw = one + b" some text between " + pdf(b"other") + b"!" + one + b" end"
        found = [(m.offset, m.length) for m in sniffer.media(raw)]
        second = len(one) + 19
        assert found == [(0, len(one)), (second, len(pdf(b"other"))), (second + len(pdf(b"other")) + 1, len(one))], one[:8]


def test_time_is_linear_in_values_full_of_headers():
    sniffer = media.Sniffer()
    for part in (b"%PDF-1.4 ", b"PK\x03\x04 PK\x05\x06" + bytes(20), flac()[:60], b"\x1f\x8b\x08\0 ", b"%PDF-1 startxref 5 %%EOF "):
        took = []
        for n in (4_000, 16_000):
            began = time.perf_counter()
            assert sniffer.media(part * n) == []
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.05, (part[:12], took)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        want = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (
            len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), len(want) + 44
        )
