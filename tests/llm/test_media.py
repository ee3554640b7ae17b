import hashlib
import os
import zlib

import numpy as np
import pytest

from tessera.llm import media as M


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 640, 4097, 70000])
def test_round_trip(size):
    for raw in (os.urandom(size), b"\xff" * size, b"\x80\x00" * (size // 2)):
        image = M.decode_jpegs([M.encode_jpeg(raw)])[0]
        n, payload = M.stored_payload(image)
        assert n == len(raw) and payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_zigzag_is_the_format_s():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(M.ZIGZAG) == list(range(64))


def _other_jpeg(blocks, width, height, components, interval):
    """A baseline JPEG by a plain bit-by-bit writer with other tables: DC sizes and AC run/size codes of 8 bits, with EOB and ZRL."""
    dc_symbols, ac_symbols = bytes(range(12)), bytes(sorted({0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))}))
    dc_lengths, ac_lengths = bytes([0] * 3 + [12] + [0] * 12), bytes([0] * 7 + [len(ac_symbols)] + [0] * 8)
    bits, out, last = [], bytearray(), {}

    def put(value, size):
        bits.extend((value >> k) & 1 for k in range(size - 1, -1, -1))

    def flush():
        while len(bits) % 8:
            bits.append(1)
        for k in range(0, len(bits), 8):
            byte = int("".join(map(str, bits[k : k + 8])), 2)
            out.append(byte)
            if byte == 255:
                out.append(0)
        bits.clear()

    def number(v):
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    mcu = sum(h * v for h, v in components)
    part = [k for k, (h, v) in enumerate(components) for _ in range(h * v)]
    for m in range(len(blocks) // mcu):
        if m and m % interval == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            last.clear()
        for b in range(mcu):
            z = blocks[m * mcu + b]
            size, value = number(int(z[0]) - last.get(part[b], 0))
            last[part[b]] = int(z[0])
            put(size, 4)
            put(value, size)
            run = 0
            top = max([k for k in range(1, 64) if z[k]], default=0)
            for k in range(1, top + 1):
                if not z[k]:
                    run += 1
                    continue
                while run > 15:
                    put(ac_symbols.index(0xF0), 8)
                    run -= 16
                size, value = number(int(z[k]))
                put(ac_symbols.index(run << 4 | size), 8)
                put(value, size)
                run = 0
            if top < 63:
                put(ac_symbols.index(0), 8)
    flush()
    seg = M._segment
    frame = bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(components)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(components))
    scan = bytes([len(components)]) + b"".join(bytes([k + 1, 0]) for k in range(len(components))) + bytes([0, 63, 0])
    return b"\xff\xd8" + seg(0xDB, b"\0" + bytes([2] * 64)) + seg(0xC0, frame) + seg(0xC4, b"\0" + dc_lengths + dc_symbols) + seg(0xC4, b"\x10" + ac_lengths + ac_symbols) + seg(0xDD, bytes([interval >> 8, interval & 255])) + seg(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("components,interval", [([(1, 1)], 1000), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1), (1, 1)], 1000)])
def test_general_decoder(components, interval):
    rng = np.random.default_rng(5)
    h, v = max(c[0] for c in components), max(c[1] for c in components)
    across, down = 3, 2
    mcu = sum(a * b for a, b in components)
    blocks = rng.integers(-60, 60, (across * down * mcu, 64)) * (rng.random((across * down * mcu, 64)) < 0.2)
    image = M.decode_jpegs([_other_jpeg(blocks, across * 8 * h, down * 8 * v, components, interval)])[0]
    at = 0
    for k, (ch, cv) in enumerate(components):
        grid = image.coefficients[k + 1]
        for m in range(across * down):
            own = blocks[m * mcu + at : m * mcu + at + ch * cv].reshape(cv, ch, 64)
            r, c = m // across * cv, m % across * ch
            assert (grid[r : r + cv, c : c + ch] == own).all()
        at += ch * cv
    thumb = image.thumbnail()
    assert thumb.shape == (down * v, across * h) and thumb[0, 0] == np.clip(round(blocks[0][0] * 2 / 8 + 128), 0, 255)


def test_rejects_what_is_not_baseline():
    good = M.encode_jpeg(b"x")
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            M.decode_jpegs([bad])


def test_query_columns(spark, odd_docs, no_docs):
    rows = M.media_features(M.encode_media(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and M.media_features(M.encode_media(no_docs)).count() == 0
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    got = {r["doc_id"]: r for r in rows}
    for ident, text in texts:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[ident]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = M.encode_jpeg(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[5]["feature"] == got[8]["feature"] and got[1]["feature"] == got[2]["feature"]
