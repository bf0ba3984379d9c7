"""Media columns: signature sniffing, validation and carving.

An Aho-Corasick automaton over the magic bytes of all formats finds every candidate offset
of a blob in one scan. A format's validator reads the structure that starts there - headers,
chunk lengths, checksums - and says which type it is, how long it is, and what its 8-bit samples are
where it can read them (null for other valid files); candidates that don't hold are dropped. Regions are taken from left to right without overlap. A valid
region at offset 0 corrects the declared type; others are carved as embedded media.

``store`` is the other direction: it keeps the bytes of a text as the 8-bit samples of a
WAV, AU, BMP or PNG file, chosen by the text's checksum, some with a wrong declared type
and some inside an opaque wrapper. Both work on one row at a time: no shuffle, and memory
for a batch of rows. Null texts are empty; their payload is one block of zeros.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import table

BLOCK = 64
OPAQUE = "application/octet-stream"
# Media types and the magic bytes of their formats.
MAGIC = {"audio/basic": b".snd", "audio/wav": b"RIFF", "image/bmp": b"BM", "image/png": b"\x89PNG\r\n\x1a\n"}
TYPES = list(MAGIC)
# Magic bytes of the formats that are only read; those of MPEG audio are the frame headers of layer 3 without a checksum.
OTHER_MAGIC = [
    ("image/jpeg", b"\xff\xd8\xff"), ("image/gif", b"GIF87a"), ("image/gif", b"GIF89a"), ("application/pdf", b"%PDF-"), ("application/zip", b"PK\x03\x04"), ("audio/flac", b"fLaC"),
    ("audio/mpeg", b"ID3"), ("audio/mpeg", b"\xff\xfb"), ("audio/mpeg", b"\xff\xf3"), ("audio/ogg", b"OggS"),
]
BIT_RATES = {3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000)}
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def payload_of(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or BLOCK * (not data))


# --- writers: samples to files ---


def write_wav(x: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(x)) + x


def write_au(x: bytes) -> bytes:
    return b".snd" + struct.pack(">5I", 24, len(x), 2, 8000, 1) + x


def write_bmp(x: bytes) -> bytes:
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = struct.pack("<IiiHHIIiiII", 40, BLOCK, -(len(x) // BLOCK), 1, 8, 0, len(x), 2835, 2835, 256, 256)
    at = 14 + len(head) + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(x), 0, 0, at) + head + palette + x


def write_png(x: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((len(x) // BLOCK, BLOCK + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(x, np.uint8).reshape(-1, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return MAGIC["image/png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


WRITERS = {"audio/basic": write_au, "audio/wav": write_wav, "image/bmp": write_bmp, "image/png": write_png}


# --- validators: type, length and samples (None if it has none of 8 bits) of the file that starts at an offset; None if there is none ---


def read_riff(b: bytes, at: int):
    """WAVE and WebP: a tree of chunks."""
    if len(b) < at + 12 or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP"):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, form, samples, kinds = at + 12, None, None, set()
    while pos + 8 <= end:
        kind, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + n > end:
            return None
        kinds.add(kind)
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", b, pos + 8)
        if kind == b"data":
            samples = (pos + 8, n)
        pos += 8 + n + n % 2
    if b[at + 8 : at + 12] == b"WEBP":
        return ("image/webp", end - at, None) if kinds & {b"VP8 ", b"VP8L", b"VP8X"} else None
    if form is None or samples is None or not form[1] or not form[2]:
        return None
    return "audio/wav", end - at, b[samples[0] : sum(samples)] if (form[0], form[5]) == (1, 8) else None


def read_au(b: bytes, at: int):
    if len(b) < at + 24:
        return None
    start, n, encoding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    n = len(b) - at - start if n == 0xFFFFFFFF else n
    if start < 24 or not 1 <= encoding <= 27 or not 0 < rate <= 768_000 or not 1 <= channels <= 64 or n < 0 or at + start + n > len(b):
        return None
    return "audio/basic", start + n, b[at + start : at + start + n] if (encoding, channels) == (2, 1) else None


def read_bmp(b: bytes, at: int):
    if len(b) < at + 54:
        return None
    size, zero, start = struct.unpack_from("<III", b, at + 2)
    head, width, height, planes, bits, packed = struct.unpack_from("<IiiHHI", b, at + 14)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed not in (0, 1, 2, 3) or width < 1 or not height or start < 14 + head or at + size > len(b):
        return None
    stride = (width * bits + 31) // 32 * 4
    if packed in (0, 3) and size < start + stride * abs(height) or size <= start:
        return None
    if bits != 8 or packed:
        return "image/bmp", size, None
    rows = np.frombuffer(b, np.uint8, stride * abs(height), at + start).reshape(-1, stride)[:, :width]
    return "image/bmp", size, (rows if height < 0 else rows[::-1]).tobytes()


def unfiltered(rows: np.ndarray):
    """The samples of PNG rows of one byte a pixel, each row's filter first; None for an unknown filter."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    if not rows[:, 0].any():
        return rows[:, 1:]
    for k, row in enumerate(rows):
        x, up = row[1:], out[k]
        if row[0] == 0:
            out[k + 1] = x
        elif row[0] == 1:
            out[k + 1] = np.cumsum(x, dtype=np.uint64).astype(np.uint8)
        elif row[0] == 2:
            out[k + 1] = x + up
        elif row[0] in (3, 4):
            left = corner = 0
            for i, (v, above) in enumerate(zip(x.tolist(), up.tolist())):
                if row[0] == 3:
                    guess = (left + above) // 2
                else:
                    near = left + above - corner
                    guess = min((left, above, corner), key=lambda c: abs(near - c))
                left, corner = (v + guess) & 255, above
                out[k + 1, i] = left
        else:
            return None
    return out[1:]


def read_png(b: bytes, at: int):
    pos, head, data = at + 8, None, []
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        body, pos = b[pos + 8 : pos + 8 + n], pos + 12 + n
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    else:
        return None
    if head is None or not head[0] or not head[1] or head[2] not in PNG_DEPTHS.get(head[3], ()) or head[4:6] != (0, 0) or head[6] > 1:
        return None
    width, height, bits = head[0], head[1], head[2] * PNG_CHANNELS[head[3]]
    row = lambda w: 1 + (w * bits + 7) // 8
    if head[6]:
        sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in ADAM7]
        most = sum(row(w) * h for w, h in sizes if w > 0 and h > 0)
    else:
        most = row(width) * height
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), most + 1)
    except zlib.error:
        return None
    if len(raw) != most:
        return None
    samples = None
    if bits == 8 and head[3] in (0, 3) and not head[6]:
        if (samples := unfiltered(np.frombuffer(raw, np.uint8).reshape(-1, width + 1))) is None:
            return None
        samples = samples.tobytes()
    return "image/png", pos - at, samples


def read_jpeg(b: bytes, at: int):
    """Marker segments, and after a scan's header its data up to the next marker, until the end of the image."""
    pos, framed = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        if kind == 0xFF:
            pos += 1
            continue
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or kind in (0x00, 0x01, 0xD8) or 0xD0 <= kind <= 0xD7:
            return None
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if kind == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] in (0x00, 0xFF) or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 1 if b[pos + 1] == 0xFF else 2
            if pos < 0 or pos + 1 >= len(b):
                return None
        if b[pos : pos + 2] == b"\xff\xd9":
            return ("image/jpeg", pos + 2 - at, None) if framed and kind == 0xDA else None
    return None


def read_gif(b: bytes, at: int):
    if len(b) < at + 13:
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    pos, images = at + 13 + table(b[at + 10]), 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return ("image/gif", pos + 1 - at, None) if images else None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            images += 1
            pos += 11 + table(b[pos + 9])
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def read_pdf(b: bytes, at: int):
    """Up to the last end mark before another PDF starts; it must name the place of its last cross-reference."""
    after = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, after if after >= 0 else len(b))
    if end < 0 or not b[at + 5 : at + 6].isdigit():
        return None
    start = b.rfind(b"startxref", at, end)
    place = b[start + 9 : end].split() if start >= 0 else []
    if len(place) != 1 or not place[0].isdigit() or not int(place[0]) < end - at:
        return None
    return "application/pdf", end + 5 - at, None


def read_zip(b: bytes, at: int):
    """Up to the end record whose directory starts where it says and lists the entries."""
    pos = at
    while (pos := b.find(b"PK\x05\x06", pos)) >= 0 and pos + 22 <= len(b):
        n, size, start, note = struct.unpack_from("<HIIH", b, pos + 10)
        if n and at + start + size == pos and b[at + start : at + start + 4] == b"PK\x01\x02" and pos + 22 + note <= len(b):
            return "application/zip", pos + 22 + note - at, None
        pos += 4
    return None


def read_flac(b: bytes, at: int):
    """Metadata blocks, of which the first describes the stream, and frames to the end of the blob, as frames don't say how long they are."""
    pos, last, first = at + 4, False, True
    while not last:
        if pos + 4 > len(b):
            return None
        last, kind, n = b[pos] >> 7, b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if kind == 127 or first != (kind == 0) or first and n != 34:
            return None
        pos, first = pos + 4 + n, False
    return ("audio/flac", len(b) - at, None) if b[pos : pos + 2] in (b"\xff\xf8", b"\xff\xf9") else None


def read_mp3(b: bytes, at: int):
    """A tag, if there is one, and three or more frames, each as long as its header says."""
    pos, frames = at, 0
    if b[at : at + 3] == b"ID3":
        if len(b) < at + 10 or b[at + 3] > 4 or max(b[at + 6 : at + 10]) > 127:
            return None
        pos += 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9])
    while pos + 4 <= len(b) and b[pos] == 0xFF and b[pos + 1] & 0xE6 == 0xE2:
        version, rate, sampling, pad = b[pos + 1] >> 3 & 3, b[pos + 2] >> 4, b[pos + 2] >> 2 & 3, b[pos + 2] >> 1 & 1
        if version < 2 or not 0 < rate < 15 or sampling == 3:
            break
        n = (144 if version == 3 else 72) * BIT_RATES[version][rate - 1] * 1000 // SAMPLE_RATES[version][sampling] + pad
        if pos + n > len(b):
            break
        pos, frames = pos + n, frames + 1
    return ("audio/mpeg", pos - at, None) if frames >= 3 else None


def read_ogg(b: bytes, at: int):
    """Pages from the one that begins a stream to the one that ends it."""
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        flags, n = b[pos + 5], b[pos + 26]
        if (pos == at) != bool(flags & 2):
            return None
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos > len(b):
            return None
        if flags & 4:
            return "audio/ogg", pos - at, None
    return None


READERS = {
    "audio/basic": read_au, "audio/wav": read_riff, "image/bmp": read_bmp, "image/png": read_png, "image/jpeg": read_jpeg, "image/gif": read_gif, "application/pdf": read_pdf, "application/zip": read_zip,
    "audio/flac": read_flac, "audio/mpeg": read_mp3, "audio/ogg": read_ogg,
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, magic in [*MAGIC.items(), *OTHER_MAGIC]:
        out.add_word(magic.decode("latin-1"), (kind, len(magic)))
    out.make_automaton()
    return out


def regions(blob: bytes, find: ahocorasick.Automaton) -> list[tuple[str, int, int, bytes | None]]:
    """(type, offset, length, samples) of each valid file in ``blob``, from the left, without overlap."""
    out, free = [], 0
    for last, (kind, n) in find.iter(blob.decode("latin-1")):
        at = last - n + 1
        if at >= free and (found := READERS[kind](blob, at)):
            out.append((found[0], at, *found[1:]))
            free = at + found[1]
    return out


def stored(text: str | None) -> tuple[int, str, bytes]:
    """Length of the text in bytes, declared type, and the blob that keeps it."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pick = zlib.crc32(data)
    kind = TYPES[pick % len(TYPES)]
    blob = WRITERS[kind](payload_of(data))
    form = (pick >> 8) % 3
    if form == 2:
        return len(data), OPAQUE, b"\x00box" + struct.pack("<I", pick) + blob + b"\x00end"
    return len(data), kind if form == 0 else TYPES[(pick + 1) % len(TYPES)], blob


def _store(batches):
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            n, kind, blob = zip(*(stored(t.as_py()) for t in part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(kind), pa.array(blob, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: each text as a media file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, declared string, media binary")


def features(samples: bytes) -> str:
    """Mean, root mean square about 128, crossings of 128 and entropy in bits of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return "mean=0.000 rms=0.000 crossings=0 entropy=0.0000"
    p = np.bincount(x, minlength=256) / len(x)
    v = np.arange(256.0)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.0
    return f"mean={(p * v).sum():.3f} rms={np.sqrt((p * (v - 128) ** 2).sum()):.3f} crossings={np.count_nonzero(np.diff(x >= 128))} entropy={entropy:.4f}"


_SNIFFED = "doc_id long, n_bytes long, declared string, detected string, carved string, samples binary, media_bytes long, media_sha256 string"


def _sniff(batches):
    find = automaton()
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            out = []
            for blob in part.column(3):
                blob = blob.as_py() or b""
                found = regions(blob, find)
                detected = found[0][0] if found and found[0][1] == 0 else OPAQUE
                carved = " ".join(f"{k}@{o}+{n}" for k, o, n, _ in found if o) or None
                out.append((detected, carved, found[0][3] if found else None, len(blob), hashlib.sha256(blob).hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(cols[0]), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4])],
                ["doc_id", "n_bytes", "declared", "detected", "carved", "samples", "media_bytes", "media_sha256"],
            )


def sniff(media: DataFrame) -> DataFrame:
    """The columns of ``_SNIFFED`` for ``media(doc_id, n_bytes, declared, media)``; ``samples`` are those of the first valid file, null without one or where it has none of 8 bits."""
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(_sniff, _SNIFFED)


def _digest(batches):
    for b in batches:
        out = []
        for declared, detected, carved, x in zip(*(c.to_pylist() for c in b.columns[2:5]), b.column(5)):
            x = x.as_py() or b""
            kind = detected if carved is None else f"{detected} holds {carved}"
            out.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-BLOCK:]), f"{declared} is {kind} {features(x)}"))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:2], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), b.column(6), b.column(7), pa.array(cols[3], pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def op2_signatures(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, from the samples read back out of the stored media."""
    found = sniff(store(table(spark, sf_dir, "documents")))
    return found.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
