"""Media columns: baseline JPEG written and read in numpy.

A text's payload is stored as the quantised coefficients of a grey baseline JPEG with an
all-ones quantisation table: each byte b is the coefficient b + 1, each 64 bytes one block, in
zigzag order. A DCT of samples would lose bits, so the format's own unit, the coefficient, carries
the bytes. Every block is its own restart interval, so the reader decodes all blocks of a batch
in lockstep. The reader is a general baseline decoder (markers, any Huffman tables, several
components, sampling factors and scans, restart intervals or none).

Edge cases: a null or empty text gives one block of zero bytes; equal texts give equal media; rows
are handled one by one, so repeated rows, ties and empty tables need nothing further; other columns
of the table are not read. A text may have up to 4 GiB (the format's 65535 x 65535 samples).
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw_texts, slices

BLOCK = 64
SCAN_BYTES = 80  # 64 coefficients of 10 bits
CHUNK_BLOCKS = 1 << 15
#: Fixed values of the format: zigzag order of an 8 x 8 block, built by walking its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: ((i // 8 + i % 8), (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))))
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, width int, height int, thumb_hash string"
)


def _code_table() -> np.ndarray:
    """Bits of each byte's coefficient b + 1: a Huffman code of 10 - size bits, then size bits."""
    value = np.arange(1, 257)
    size = np.array([int(v).bit_length() for v in value])
    return ((((1 << (9 - size)) - 1) << 1 << size) | value).astype(np.uint64)


_CODES = _code_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int, n_bytes: int) -> tuple[bytes, int]:
    """Headers of an image for so many blocks; the number of blocks that its grid has."""
    wide = max(1, math.isqrt(blocks - 1) + 1)
    high = -(-blocks // wide)
    if wide * 8 > 65535 or high * 8 > 65535:
        raise ValueError("the payload is larger than a JPEG can be")
    lengths = bytes([1] * 9 + [0] * 7)
    sizes = bytes(range(9, 0, -1))
    parts = [
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">QQ", n_bytes, blocks * BLOCK)),
        _segment(0xDB, b"\0" + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + lengths + sizes),
        _segment(0xC4, b"\x10" + lengths + sizes),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
    return b"".join(parts), wide * high


def _scan(payload: np.ndarray, first: int, last: bool) -> bytes:
    """Entropy-coded data of whole blocks, with restart markers between them."""
    quads = _CODES[payload.reshape(-1, 4)]
    packed = (quads[:, 0] << np.uint64(30)) | (quads[:, 1] << np.uint64(20)) | (quads[:, 2] << np.uint64(10)) | quads[:, 3]
    bits = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1, SCAN_BYTES)
    n = len(bits)
    rows = np.empty((n, SCAN_BYTES + 2), np.uint8)
    rows[:, :SCAN_BYTES] = bits
    rows[:, SCAN_BYTES] = 0xFF
    rows[:, SCAN_BYTES + 1] = 0xD0 + ((np.arange(n) + first) & 7)
    flat = rows.reshape(-1)
    stuffed = np.zeros((n, SCAN_BYTES + 2), bool)
    stuffed[:, :SCAN_BYTES] = bits == 0xFF
    at = np.flatnonzero(stuffed.reshape(-1))
    out = np.insert(flat, at + 1, 0) if len(at) else flat
    return out[: len(out) - 2 * last].tobytes()


def encode_jpeg(raw: bytes) -> bytes:
    """The JPEG that stores raw, zero-padded to a positive multiple of 64 bytes."""
    blocks = max(1, -(-len(raw) // BLOCK))
    head, grid = _head(blocks, len(raw))
    parts = [head]
    for a in range(0, grid, CHUNK_BLOCKS):
        b = min(grid, a + CHUNK_BLOCKS)
        piece = raw[a * BLOCK : b * BLOCK]
        data = np.frombuffer(piece + bytes((b - a) * BLOCK - len(piece)), np.uint8)
        parts.append(_scan(data, a, b == grid))
    parts.append(b"\xff\xd9")
    return b"".join(parts)


@dataclass
class Image:
    """What a baseline JPEG holds: per component, coefficients [block rows, block columns, 64] in zigzag order."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)

    def thumbnail(self) -> np.ndarray:
        """Luminance at an eighth of the size, from the DC coefficients alone."""
        ident, _, _, q = self.components[0]
        dc = self.coefficients[ident][:, :, 0].astype(np.float64) * self.quant[q][0] / 8 + 128
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        rows = -(-(-(-self.height * self.components[0][2] // v)) // 8)
        cols = -(-(-(-self.width * self.components[0][1] // h)) // 8)
        return np.clip(np.rint(dc[:rows, :cols]), 0, 255).astype(np.uint8)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code starts so."""
    out, code, k = np.zeros(1 << 16, np.uint16), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _split(data: np.ndarray, start: int) -> tuple[list[tuple[int, int]], int, np.ndarray]:
    """Restart segments [a, b) of the scan at start, where it ends, and where stuffed zeros stand."""
    ff = np.flatnonzero(data[start:-1] == 0xFF) + start
    after = data[ff + 1]
    stops = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(stops[0]) if len(stops) else len(data)
    marks = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < end)]
    a = np.concatenate(([start], marks + 2))
    b = np.concatenate((marks, [end]))
    return list(zip(a.tolist(), b.tolist())), end, ff[(after == 0) & (ff < end)] + 1


@dataclass
class _Scan:
    image: Image
    parts: list  # component ids
    mcus: int
    interval: int
    key: tuple  # what scans decoded together must share
    tables: dict
    data: np.ndarray = None
    starts: np.ndarray = None


def _parse(raw: bytes) -> tuple[Image, list[_Scan]]:
    """Walk the markers; scans are left undecoded."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start-of-image marker")
    data, at, image, tables, interval, scans = np.frombuffer(raw, np.uint8), 2, Image(), {}, 0, []
    while at + 2 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("marker expected")
        marker = raw[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        (length,) = struct.unpack_from(">H", raw, at + 2)
        body, at = raw[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body[:2])
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
            across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
            for ident, ch, cv, _ in image.components:
                image.coefficients[ident] = np.zeros((down * cv, across * ch, 64), np.int16)
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            n = body[0]
            parts = [body[1 + 2 * i] for i in range(n)]
            ids = [(body[2 + 2 * i] >> 4, 0x10 | (body[2 + 2 * i] & 15)) for i in range(n)]
            shape = {c[0]: c[1:3] for c in image.components}
            h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
            if n > 1:
                pattern = [k for k, p in enumerate(parts) for _ in range(shape[p][0] * shape[p][1])]
                mcus = -(-image.width // (8 * h)) * -(-image.height // (8 * v))
            else:
                pattern = [0]
                ch, cv = shape[parts[0]]
                mcus = -(-(-(-image.width * ch // h)) // 8) * -(-(-(-image.height * cv // v)) // 8)
            used = tuple((tables[d], tables[a]) for d, a in ids)
            found, end, zeros = _split(data, at)
            bounds = np.array(found, np.int64)
            dropped = np.searchsorted(zeros, bounds)
            keep = np.ones(end - at, bool)
            keep[zeros - at] = False
            scan = _Scan(image, parts, mcus, interval or mcus, (tuple(pattern), used), {})
            scan.data = data[at:end][keep]
            scan.starts = bounds[:, 0] - at - dropped[:, 0]
            scans.append(scan)
            at = end
        if marker == 0xDA and at >= len(raw):
            break
    return image, scans


def _decode_lanes(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, pattern: tuple, used: tuple) -> np.ndarray:
    """Coefficients [64, all blocks of all lanes in order] of restart segments that begin at the byte offsets `starts`."""
    luts = [(_lookup(*d), _lookup(*a)) for d, a in used]
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    window = np.ndarray((len(data) + 9,), np.uint64, padded.data, strides=(1,))  # eight bytes from each byte on
    base = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    out = np.zeros(64 * total, np.int16)
    order = np.argsort(-blocks, kind="stable")
    left, pos, place = blocks[order], starts[order].astype(np.uint64) << np.uint64(3), base[order]
    previous = np.zeros((len(order), len(used)), np.int64)
    u = np.uint64

    def symbol(pos, lut):
        w = window[pos >> u(3)].byteswap() << (pos & u(7))
        found = lut[w >> u(48)]
        length = (found >> 8).astype(np.uint64)
        if not length.all():
            raise ValueError("bad Huffman code")
        size = (found & 15).astype(np.uint64)
        bits = (w << length) >> u(32) >> (u(32) - size)
        value = bits.astype(np.int64)
        low = (u(1) << size) >> u(1)
        value -= np.where(bits < low, (low.astype(np.int64) << 1) - 1, 0)
        return pos + length + size, (found & 0xFF) >> 4, size, value

    for b in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -b, side="left"))
        part = pattern[b % len(pattern)]
        dc, ac = luts[part]
        pos[:n], _, _, value = symbol(pos[:n], dc)
        previous[:n, part] += value
        at = place[:n] + b
        out[at] = previous[:n, part]
        lane, k, here = np.arange(n), np.ones(n, np.int64), pos[:n].copy()
        while len(lane):
            here, run, size, value = symbol(here, ac)
            k += run
            stop = (size == 0) & (run != 15)
            live = size > 0
            if live.all():
                out[k * total + at] = value
            else:
                out[k[live] * total + at[live]] = value[live]
            k += 1
            done = stop | (k > 63)
            if done.any():
                pos[lane[done]] = here[done]
                go = ~done
                lane, k, here, at = lane[go], k[go], here[go], at[go]
    return out.reshape(64, total)


def decode_jpegs(media: list[bytes]) -> list[Image]:
    """Parse and decode baseline JPEGs; scans with like tables are decoded in lockstep."""
    images, groups = [], {}
    for raw in media:
        image, scans = _parse(raw)
        images.append(image)
        for s in scans:
            groups.setdefault(s.key, []).append(s)
    for (pattern, used), scans in groups.items():
        shift = np.cumsum([0, *(len(s.data) for s in scans)])
        data = np.concatenate([s.data for s in scans])
        starts = np.concatenate([s.starts + o for s, o in zip(scans, shift)])
        per = len(pattern)
        blocks = np.concatenate([np.minimum(s.interval, s.mcus - np.arange(len(s.starts)) * s.interval) for s in scans]) * per
        pieces, lanes = [], max(1, CHUNK_BLOCKS // max(1, int(blocks.max(initial=1))))
        for a in range(0, len(starts), lanes):
            lo = int(starts[a])
            hi = int(starts[a + lanes]) if a + lanes < len(starts) else len(data)
            pieces.append(_decode_lanes(data[lo:hi], starts[a : a + lanes] - lo, blocks[a : a + lanes], pattern, used))
        flat = np.concatenate(pieces, axis=1) if len(pieces) > 1 else pieces[0]
        flat = np.ascontiguousarray(flat.T)
        at = 0
        for s in scans:
            _place(s, flat[at : at + s.mcus * per], pattern)
            at += s.mcus * per
    return images


def _place(scan: _Scan, flat: np.ndarray, pattern: tuple) -> None:
    """Put decoded blocks where they belong in their components' grids."""
    image, shape = scan.image, {c[0]: c[1:3] for c in scan.image.components}
    h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(scan.parts) == 1:
        grid = image.coefficients[scan.parts[0]]
        ch, cv = shape[scan.parts[0]]
        rows, cols = -(-(-(-image.height * cv // v)) // 8), -(-(-(-image.width * ch // h)) // 8)
        if grid.shape[:2] == (rows, cols):
            image.coefficients[scan.parts[0]] = flat.reshape(rows, cols, 64)
        else:
            grid[:rows, :cols] = flat.reshape(rows, cols, 64)
        return
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    blocks, offset = flat.reshape(down, across, len(pattern), 64), 0
    for ident in scan.parts:
        ch, cv = shape[ident]
        own = blocks[:, :, offset : offset + ch * cv].reshape(down, across, cv, ch, 64)
        image.coefficients[ident] = own.transpose(0, 2, 1, 3, 4).reshape(down * cv, across * ch, 64)
        offset += ch * cv


def stored_payload(image: Image) -> tuple[int, bytes]:
    """(unpadded length, padded payload) that encode_jpeg() put into the image."""
    n_bytes, size = struct.unpack(">QQ", image.comment)
    flat = next(iter(image.coefficients.values())).reshape(-1)[:size]
    return n_bytes, (flat - 1).astype(np.uint8).tobytes()


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 x 8 evenly spaced thumbnail pixels are above their mean; then a checksum of all pixels."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(8) * thumb.shape[1] // 8
    small = thumb[rows[:, None], cols].reshape(-1).astype(np.int64)
    bits = np.packbits(small * 64 > small.sum()).tobytes()
    return f"{bits.hex()}-{zlib.crc32(thumb.tobytes()):08x}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text as a JPEG: (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            texts = raw_texts(batch.column(1))
            media = pa.array([encode_jpeg(x) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Read stored JPEGs (doc_id, n_bytes, media) back: payload digests, dimensions and thumbnail hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in slices(batches, 2, 4 << 20):
            stored = batch.column(2).to_pylist()
            rows = []
            for ident, raw, image in zip(batch.column(0).to_pylist(), stored, decode_jpegs(stored)):
                n_bytes, payload = stored_payload(image)
                thumb = thumbnail_hash(image.thumbnail())
                rows.append(
                    (ident, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"jpeg:{image.width}x{image.height}:{thumb}", image.width, image.height, thumb)
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.mapInArrow(run, FEATURE_SCHEMA)
