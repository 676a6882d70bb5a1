"""Media columns: what bytes really are, by signature and structure.

One Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. At each hit the format's validator follows the
structure (chunk lengths, segment markers, checksums where they are cheap) and gives the exact length, or rejects. A value that is one
valid medium from its first to its last byte has that type, whatever was declared; valid media at other places are embedded ones and are
carved: those inside another carved one are left to it, but those inside the value's own medium are listed.

The ends of archives, the trailers of PDF files and the places of their headers are found once a value, so a value full of headers costs no
more than its length. A PDF ends at its last trailer before the next header whose offset points at a cross-reference; a FLAC stream is
followed frame by frame by its checksums (its last frame may end early where 16 bits agree by chance: one in 65,536 a byte).

Edge cases: a null or empty value has the declared type's correction ``empty`` and no media. Truncated media, and text that merely holds
magic bytes, are rejected by the validators. Rows that repeat get equal results. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty


def _places(value: bytes, part: bytes) -> list[int]:
    out, at = [], value.find(part)
    while at >= 0:
        out.append(at)
        at = value.find(part, at + 1)
    return out


_TRAILER = re.compile(rb"startxref\s{1,16}(\d{1,18})\s{1,16}%%EOF")


class Value(bytes):
    """The bytes of a value and what validators look up in it."""

    @cached_property
    def archives(self) -> dict[int, int]:
        """End of the ZIP archive that starts at a place."""
        out: dict[int, int] = {}
        for end in _places(self, b"PK\x05\x06"):
            if end + 22 <= len(self):
                size, start, note = struct.unpack_from("<IIH", self, end + 12)
                at = end - size - start
                if at >= 0 and self[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(self):
                    out.setdefault(at, end + 22 + note)
        return out

    @cached_property
    def trailers(self) -> list[tuple[int, int, int]]:
        """(place, offset of the cross-reference, end) of each PDF trailer."""
        return [(m.start(), int(m[1]), m.end()) for m in _TRAILER.finditer(self)]

    @cached_property
    def pdfs(self) -> list[int]:
        return _places(self, b"%PDF-")

    @cached_property
    def flacs(self) -> list[int]:
        return _places(self, b"fLaC")

    def after(self, places: list[int], at: int) -> int:
        """The first of ``places`` behind ``at``, or the end of the value."""
        i = bisect_right(places, at)
        return places[i] if i < len(places) else len(self)


def _riff(kind: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if len(b) < at + 12 or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        place, seen = at + 12, set()
        if end > len(b):
            return None
        while place + 8 <= end:
            name, size = b[place : place + 4], struct.unpack_from("<I", b, place + 4)[0]
            seen.add(name)
            place += 8 + size + size % 2
        ok = place == end and (kind != b"WAVE" or {b"fmt ", b"data"} <= seen) and (kind != b"WEBP" or seen & {b"VP8 ", b"VP8L", b"VP8X"})
        return end - at if ok else None

    return check


def _png(b: bytes, at: int) -> int | None:
    place = at + 8
    first = True
    while place + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, place)
        if first and (name != b"IHDR" or size != 13) or place + 12 + size > len(b):
            return None
        if zlib.crc32(b[place + 4 : place + 8 + size]) != struct.unpack_from(">I", b, place + 8 + size)[0]:
            return None
        first, place = False, place + 12 + size
        if name == b"IEND":
            return place - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 14:
        return None
    flags, place = b[at + 10], at + 13
    place += 3 << (flags & 7) + 1 if flags & 128 else 0

    def blocks(p: int) -> int | None:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1 if p < len(b) else None

    images = 0
    while place is not None and place < len(b):
        kind = b[place]
        if kind == 0x3B:
            return place + 1 - at if images else None
        if kind == 0x21:
            place = blocks(place + 2)
        elif kind == 0x2C and place + 10 < len(b):
            local = b[place + 9]
            place = blocks(place + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
            images += 1
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    place, frames = at + 2, 0
    while place + 4 <= len(b) and b[place] == 0xFF:
        kind = b[place + 1]
        if kind == 0xD9:
            return place + 2 - at if frames else None
        if kind in (0x01, *range(0xD0, 0xD8)):
            place += 2
            continue
        size = struct.unpack_from(">H", b, place + 2)[0]
        if size < 2 or place + 2 + size > len(b):
            return None
        frames += kind in (0xC0, 0xC1, 0xC2)
        place += 2 + size
        if kind == 0xDA:  # entropy-coded data ends at a marker that is no restart and no stuffing
            while True:
                place = b.find(b"\xff", place)
                if place < 0 or place + 1 >= len(b):
                    return None
                if b[place + 1] != 0 and not 0xD0 <= b[place + 1] <= 0xD7:
                    break
                place += 2
    return place + 2 - at if frames and b[place : place + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, reserved, start, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or not 14 + header <= start <= size or width <= 0:
        return None
    return size if at + size <= len(b) and struct.unpack_from("<I", b, at + 30)[0] == 0 and start + (
        width * depth + 31
    ) // 32 * 4 * abs(height) <= size else None


def _gzip(b: bytes, at: int) -> int | None:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    try:
        place = at
        while place < len(b) and not unpack.eof:
            unpack.decompress(b[place : place + 65536])
            place += 65536
    except zlib.error:
        return None
    return min(place, len(b)) - at - len(unpack.unused_data) if unpack.eof else None


def _pdf(b: Value, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    i = bisect_right(b.trailers, (b.after(b.pdfs, at),))
    while i and b.trailers[i - 1][0] > at:
        i -= 1
        place, offset, end = b.trailers[i]
        if 0 < offset < place - at and re.match(rb"xref\b|\d{1,10}\s+\d{1,5}\s+obj\b", b[at + offset : at + offset + 32]):
            return end - at
    return None


def _zip(b: Value, at: int) -> int | None:
    end = b.archives.get(at)
    return end - at if end else None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (polynomial if crc >> (bits - 1) & 1 else 0)
        table.append(crc & ((1 << bits) - 1))
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(bytes of the header, samples) of the FLAC frame at a place."""
    if len(b) < at + 6 or b[at] != 0xFF or b[at + 1] not in (0xF8, 0xF9):
        return None
    block, rate, channels, depth, first = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] & 15, b[at + 4]
    if not block or rate == 15 or channels > 10 or depth & 1 or depth == 6 or 0x80 <= first < 0xC0 or first == 0xFF:
        return None
    place = at + 4 + (1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length())
    size = 1 if block == 6 else 2 if block == 7 else 0
    samples = 192 if block == 1 else 576 << block - 2 if block < 6 else int.from_bytes(b[place : place + size], "big") + 1 if block < 8 else 256 << block - 8
    place += size + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if place >= len(b):
        return None
    crc = 0
    for byte in b[at:place]:
        crc = _CRC8[crc ^ byte]
    return (place + 1 - at, samples) if crc == b[place] else None


def _flac(b: Value, at: int) -> int | None:
    place, info = at + 4, None
    while True:
        kind, size = b[place] & 127 if place < len(b) else 127, int.from_bytes(b[place + 1 : place + 4], "big")
        if info is None and (kind, size) != (0, 34) or place + 4 + size > len(b) or kind == 127:
            return None
        info, last, place = info or b[place + 4 : place + 38], b[place] >> 7, place + 4 + size
        if last:
            break
    least, most, total = int.from_bytes(info[4:7], "big"), int.from_bytes(info[7:10], "big"), int.from_bytes(info[13:18], "big") & (1 << 36) - 1
    limit, done = b.after(b.flacs, at), 0
    frame = _flac_frame(b, place)
    while frame:
        header, samples = frame
        done, frame, end, crc = done + samples, None, None, 0
        stop = min(limit, place + most) if most else limit
        for i in range(place, stop):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[i]]
            if not crc and i + 1 - place >= max(least, header + 3):
                if total and done >= total:
                    return i + 1 - at
                end = end or i + 1
                if frame := _flac_frame(b, i + 1):
                    place = i + 1
                    break
    return end - at if done and not total and end else None


def _form(b: bytes, at: int) -> int | None:
    size = int.from_bytes(b[at + 4 : at + 8], "big")
    return size + 8 if b[at + 8 : at + 12] in (b"AIFF", b"AIFC") and size >= 4 and at + 8 + size <= len(b) and b[at + 12 : at + 16] in (
        b"COMM", b"FVER", b"MARK", b"NAME", b"SSND", b"COMT"
    ) else None


# Boxes at the top level of ISO base media files.
_BOXES = {
    b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"ssix", b"styp", b"meta", b"uuid", b"udta", b"pdin",
    b"prft", b"emsg"
}


def _boxes(b: bytes, at: int) -> int | None:
    place, seen = at, set()
    while place + 8 <= len(b) and (kind := b[place + 4 : place + 8]) in _BOXES and not (kind == b"ftyp" and seen):
        size = int.from_bytes(b[place : place + 4], "big")
        size = int.from_bytes(b[place + 8 : place + 16], "big") if size == 1 else size or len(b) - place
        if size < 8 or place + size > len(b):
            return None
        seen.add(kind)
        place += size
    return place - at if b"ftyp" in seen and seen & {b"moov", b"moof", b"meta"} else None


# kbit/s of MPEG audio layer III, version 1 and versions 2 and 2.5, and samples a second of version 1.
_MP3_RATES = [[32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]]
_MP3_SAMPLES = [44_100, 48_000, 32_000]


def _mp3(b: bytes, at: int) -> int | None:
    place, frames = at, 0
    if b[at : at + 3] == b"ID3":
        if len(b) < at + 10 or max(b[at + 6 : at + 10]) > 127:
            return None
        place += 10 + sum(x << 7 * (3 - i) for i, x in enumerate(b[at + 6 : at + 10]))
    while place + 4 <= len(b) and b[place] == 0xFF and b[place + 1] & 0xE6 == 0xE2:
        version, rate, sample = b[place + 1] >> 3 & 3, b[place + 2] >> 4, b[place + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or sample == 3:
            break
        old = version != 3
        size = (72 if old else 144) * _MP3_RATES[old][rate - 1] * 1000 // (_MP3_SAMPLES[sample] >> {3: 0, 2: 1, 0: 2}[version]) + (b[place + 2] >> 1 & 1)
        if place + size > len(b):
            return None
        place, frames = place + size, frames + 1
    if b[place : place + 3] == b"TAG" and place + 128 <= len(b):
        place += 128
    return place - at if frames >= 3 else None


def _matroska(b: bytes, at: int) -> int | None:
    def sized(place: int) -> int | None:
        """Where the content of the element whose size stands at a place ends."""
        if place >= len(b) or not b[place]:
            return None
        n = 9 - b[place].bit_length()
        size = int.from_bytes(b[place : place + n], "big") & (1 << 7 * n) - 1
        return None if size == (1 << 7 * n) - 1 or place + n + size > len(b) else place + n + size

    head = sized(at + 4)
    if head is None or not any(t in b[at:head] for t in (b"matroska", b"webm")) or b[head : head + 4] != b"\x18\x53\x80\x67":
        return None
    end = sized(head + 4)
    return end - at if end else None


def _tiff(b: bytes, at: int) -> int | None:
    order = "little" if b[at : at + 1] == b"I" else "big"
    number = lambda place, n: int.from_bytes(b[place : place + n], order)
    end, listed, seen = at + 8, number(at + 4, 4), set()
    while listed:
        start = at + listed
        count = number(start, 2)
        if listed in seen or listed < 8 or not count or start + 6 + 12 * count > len(b):
            return None
        seen.add(listed)
        fields = {}
        for i in range(count):
            place = start + 2 + 12 * i
            tag, kind, n = number(place, 2), number(place + 2, 2), number(place + 4, 4)
            width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}.get(kind)
            if not width:
                return None
            where = at + number(place + 8, 4) if width * n > 4 else place + 8
            if where + width * n > len(b):
                return None
            end = max(end, where + width * n)
            if tag in (273, 279, 324, 325):
                fields[tag] = [number(where + width * k, width) for k in range(n)]
        for starts, sizes in ((273, 279), (324, 325)):
            for a, n in zip(fields.get(starts, []), fields.get(sizes, []), strict=False):
                end = max(end, at + a + n)
        end, listed = max(end, start + 6 + 12 * count), number(start + 2 + 12 * count, 4)
        if not fields or end > len(b):
            return None
    return end - at if seen else None


def _ogg(b: bytes, at: int) -> int | None:
    place = at
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b):
        n = b[place + 26]
        if b[place + 4] or place + 27 + n > len(b):
            return None
        last, place = b[place + 5] & 4, place + 27 + n + sum(b[place + 27 : place + 27 + n])
        if place > len(b):
            return None
        if last:
            return place - at
    return None


#: Magic bytes, type, validator, bytes before the magic ones.
FORMATS: list[tuple[bytes, str, Callable[[Value, int], int | None], int]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png, 0),
    (b"GIF87a", "image/gif", _gif, 0),
    (b"GIF89a", "image/gif", _gif, 0),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg, 0),
    (b"BM", "image/bmp", _bmp, 0),
    (b"II*\0", "image/tiff", _tiff, 0),
    (b"MM\0*", "image/tiff", _tiff, 0),
    (b"RIFF", "audio/wav", _riff(b"WAVE"), 0),
    (b"RIFF", "image/webp", _riff(b"WEBP"), 0),
    (b"RIFF", "video/avi", _riff(b"AVI "), 0),
    (b"FORM", "audio/aiff", _form, 0),
    (b"fLaC", "audio/flac", _flac, 0),
    (b"OggS", "audio/ogg", _ogg, 0),
    (b"ID3", "audio/mpeg", _mp3, 0),
    (b"\xff\xfb", "audio/mpeg", _mp3, 0),
    (b"\xff\xf3", "audio/mpeg", _mp3, 0),
    (b"ftyp", "video/mp4", _boxes, 4),
    (b"\x1a\x45\xdf\xa3", "video/x-matroska", _matroska, 0),
    (b"%PDF-", "application/pdf", _pdf, 0),
    (b"PK\x03\x04", "application/zip", _zip, 0),
    (b"\x1f\x8b\x08", "application/gzip", _gzip, 0),
]


@dataclass(frozen=True)
class Medium:
    offset: int
    length: int
    kind: str


class Sniffer:
    def __init__(self, formats=FORMATS):
        import ahocorasick

        self.by_magic: dict[str, list] = {}
        for magic, kind, check, before in formats:
            self.by_magic.setdefault(magic.decode("latin-1"), []).append((len(magic) + before, kind, check))
        self.automaton = ahocorasick.Automaton()
        for magic, entries in self.by_magic.items():
            self.automaton.add_word(magic, entries)
        self.automaton.make_automaton()

    def media(self, value: bytes) -> list[Medium]:
        """Valid media in order of offset; one that lies in an earlier one is listed only if that one is the whole value."""
        out, covered, value = [], 0, Value(value)
        for end, entries in self.automaton.iter(value.decode("latin-1")):
            for size, kind, check in entries:
                at = end + 1 - size
                if at < covered:
                    continue
                length = check(value, at)
                if length:
                    out.append(Medium(at, length, kind))
                    if length < len(value):
                        covered = at + length
                    break
        return out


def sniffed(df: DataFrame, value: str, declared: str, keep: list[str]) -> DataFrame:
    """Add ``media_type`` (the value's own type: what was found, else the declared one if it has no signature here, else unknown),
    ``corrected`` (the declared type was wrong) and ``media`` (offset, length, type of all found) to the ``keep`` columns."""
    bounded_batches(df.sparkSession)
    known = {kind for _, kind, *_ in FORMATS}
    fields = [df.schema[c] for c in keep]
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in fields
    ) + ", media_type string, corrected boolean, media array<struct<offset: long, length: long, type: string>>"
    listed = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            kinds, wrong, found = [], [], []
            for raw, said in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                raw, said = raw.as_py() or b"", said.as_py()
                media = sniffer.media(raw)
                kind = own_type(raw, media) or ("empty" if not raw else said if said and said not in known else "unknown")
                kinds.append(kind)
                wrong.append(kind != said)
                found.append([{"offset": m.offset, "length": m.length, "type": m.kind} for m in media])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(kinds), pa.array(wrong), pa.array(found, listed)],
                [*batch.schema.names[:-2], "media_type", "corrected", "media"]
            )

    return df.select(*keep, F.col(value).alias("_value"), F.col(declared).alias("_declared")).mapInArrow(run, schema)


def own_type(value: bytes, media: list[Medium]) -> str | None:
    return next((m.kind for m in media if m.offset == 0 and m.length == len(value)), None)


def _le32(n: Column) -> Column:
    """Four little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)]))


def as_wav(payload: Column, rate: int = 8000) -> Column:
    """A WAV file of unsigned 8-bit mono samples: the payload, whose length is even, byte by byte."""
    size = F.octet_length(payload).cast("long")
    constant = lambda b: F.unhex(F.lit(b.hex()))
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(constant(b"RIFF"), _le32(size + 36), constant(b"WAVE" + fmt + b"data"), _le32(size), payload)


def payload(text: Column, unit: int = 64) -> Column:
    """UTF-8 bytes and zeros up to a positive multiple of ``unit``."""
    raw = F.encode(text_or_empty(text), "UTF-8")
    size = F.octet_length(raw)
    missing = F.when(size == 0, F.lit(unit)).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing)))


def samples(wav: bytes) -> bytes:
    """The data chunk of a valid WAV file of 8-bit samples."""
    place = 12
    while wav[place : place + 4] != b"data":
        place += 8 + (n := struct.unpack_from("<I", wav, place + 4)[0]) + n % 2
    return wav[place + 8 : place + 8 + struct.unpack_from("<I", wav, place + 4)[0]]


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "image/png") -> DataFrame:
    """Store every text as WAV samples under a wrong declared type, sniff what was stored, and read the samples back.

    One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_type and
    embedded (media found within the samples).
    """
    import hashlib

    bounded_batches(docs.sparkSession)
    stored = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(F.encode(text_or_empty(text_col), "UTF-8")).cast("long").alias("n_bytes"),
        as_wav(payload(F.col(text_col))).alias("media")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            rows = []
            for value in batch.column(2):
                raw = value.as_py()
                media = sniffer.media(raw)
                kind = own_type(raw, media)
                back = samples(raw) if kind == "audio/wav" else b""
                level = np.frombuffer(back, np.uint8).astype(np.float64) - 128
                rms = float(np.sqrt((level**2).mean())) if len(level) else 0.0
                crossings = int((np.signbit(level[1:]) != np.signbit(level[:-1])).sum())
                inside = len(media) - (kind is not None)
                feature = f"{kind};declared={declared};samples={len(back)};mean={level.mean() if len(level) else 0:.4f};rms={rms:.4f};crossings={crossings};embedded={inside}"
                rows.append(
                    (
                        len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(),
                        feature, kind, inside
                    )
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "embedded"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return stored.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, embedded long"
    )
