import hashlib
import random
import struct
import zlib

import pytest

from sedimenta.llm.gif_media import _blocks, decode_gif, encode_gif, frames, lzw_decode, lzw_encode, payload_of, texts_as_media


def slow_decode(data, bits):
    """A textbook decoder, bit by bit."""
    acc = int.from_bytes(data, "little")
    clear, end = 1 << bits, (1 << bits) + 1
    at, width, table, prev, out = 0, bits + 1, [], None, b""
    while True:
        code = acc >> at & ((1 << width) - 1)
        at += width
        if code == end:
            return out
        if code == clear:
            table, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        prev = entry


def samples():
    r = random.Random(2)
    return [b"", b"a", b"ab" * 9000, bytes(r.randrange(256) for _ in range(9000)), bytes(r.choice(b"etaoin ") for _ in range(30_000)), bytes(5000)]


def test_lzw_round_trip_and_textbook():
    for data in samples():
        code = lzw_encode(data)
        assert lzw_decode(code, 8, len(data)) == data == slow_decode(code, 8)
    small = bytes(random.Random(1).randrange(4) for _ in range(9000))
    assert lzw_decode(lzw_encode(small, 2), 2, len(small)) == small == slow_decode(lzw_encode(small, 2), 2)


def test_full_table_without_clear():
    """Codes of a table that stays full keep 12 bits."""
    r = random.Random(3)
    data = [r.randrange(256) for _ in range(6000)]
    acc, at, width, size = 256, 9, 9, 258
    for i, b in enumerate(data):
        acc |= b << at
        at += width
        if i and size < 4096:
            size += 1
            if size == 1 << width and width < 12:
                width += 1
    acc |= 257 << at
    code = acc.to_bytes(at // 8 + 3, "little")
    assert slow_decode(code, 8) == bytes(data) == lzw_decode(code, 8, len(data))


def test_bad_codes():
    with pytest.raises(ValueError):
        lzw_decode((256 | 400 << 9).to_bytes(4, "little"), 8, 10)
    with pytest.raises(ValueError):
        lzw_decode((256 | 65 << 9 | 300 << 18 | 257 << 27).to_bytes(6, "little"), 8, 10)


def image(left, top, w, h, pixels, delay=1, dispose=1, clear=None, interlace=False, own=b""):
    flags = (0x80 | (len(own) // 3).bit_length() - 2 if own else 0) | 0x40 * interlace
    control = b"\x21\xf9\x04" + struct.pack("<BHB", dispose << 2 | (clear is not None), delay, clear or 0) + b"\0"
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + own + b"\x02" + _blocks(lzw_encode(bytes(pixels), 2))


def test_drawing_rules():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x81, 0, 0) + palette + b"\x21\xfe\x02hi\0"
    body = image(0, 0, 4, 2, [1] * 8, delay=5) + image(1, 0, 2, 1, [2, 3], delay=7, dispose=3, clear=3) + image(0, 1, 2, 1, [3, 3], dispose=2) + image(3, 1, 1, 1, [0], own=bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6]))
    a, b, c, d = decode_gif(head + body + b"\x3b")
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert a.canvas.tolist() == [[red] * 4] * 2
    assert b.canvas.tolist() == [[red, green, red, red], [red] * 4]
    assert c.canvas.tolist() == [[red] * 4, [blue, blue, red, red]]
    assert d.canvas.tolist() == [[red] * 4, [[0, 0, 0, 0]] * 2 + [red, [9, 9, 9, 255]]]
    assert [(f.start_cs, f.delay_cs) for f in (a, b, c, d)] == [(0, 5), (5, 7), (12, 1), (13, 1)]


def test_interlace():
    rows = [i % 4 for i in range(10)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 10, 0x81, 0, 0) + bytes(12)
    f, = decode_gif(head + image(0, 0, 1, 10, [rows[i] for i in order], interlace=True) + b"\x3b")
    assert list(f.samples) == rows


def test_frames_table(spark):
    good = encode_gif(payload_of(b"hello" * 100))
    df = spark.createDataFrame([(1, bytearray(good), 0), (2, bytearray(good[:-40]), 0), (3, None, 0), (4, bytearray(b"x"), 0)], "media_id long, data binary, number int")
    rows = {r.media_id: r for r in frames(df).collect()}
    assert rows[1].samples == payload_of(b"hello" * 100) and sum(rows[1].colours) == 3 * rows[1].width * rows[1].height
    assert rows[1].error is None and all(rows[k].error for k in (2, 3, 4))
    assert frames(df.limit(0)).collect() == []


def rendered(pay):
    """The feature from a plain rendering: each frame covers the first lines of what was there before."""
    shown, canvas, tall = [], b"", 65_535 * 64
    for i in range(0, len(pay), tall):
        canvas = pay[i : i + tall] + canvas[len(pay[i : i + tall]) :]
        n = [0] * 16
        for value in range(256):
            n[value // 16] += canvas.count(bytes([value]))
        shown.append(f"{i // tall * 4}:4:{','.join(map(str, n * 3))}")
    return ";".join(shown)


def test_texts(spark):
    texts = [None, "", "é" * 32, "plain text " * 50, "y" * 64, "plain text " * 50, "z" * (65_535 * 64 + 100)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in texts_as_media(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        pay = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        gif = encode_gif(pay)
        assert (r.media_bytes, r.media_sha256) == (len(gif), hashlib.sha256(gif).hexdigest())
        assert r.feature == rendered(pay)
    assert got[6].n_frames == 2 and got[3].media_sha256 == got[5].media_sha256
