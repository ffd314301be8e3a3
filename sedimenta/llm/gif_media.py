"""GIF frames as columns: a decoder of LZW code streams, palettes, interlace, disposal and transparency.

encode_gif() stores bytes losslessly as 8-bit palette samples: ROW samples a line, the identity grey palette,
a frame of up to MAX_LINES lines at a time. decode_gif() reads any GIF: it inflates each frame's codes, applies the local
or global palette, de-interlaces, draws over the canvas with transparency and disposal, and yields timed frames.
frames() is the operator on tables of GIF bytes, with a colour histogram for each frame.

The LZW decoder takes codes in runs: between two clear codes the code widths depend on the number of codes
only, so numpy extracts a whole run of codes at once, and finds its strings by pointer doubling.

Nulls and edge cases: null bytes and damaged files have no frames and an error text; a null payload text counts as empty
and is stored as one line of zeros; equal texts give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

ROW, MAX_LINES, BINS = 64, 65_535, 16
_GREY = bytes(v for i in range(256) for v in (i, i, i))
MAX_CODE = 4096


_schedule: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the k-th code after a clear, and its bit offset, for as long as widths change and a bit more."""
    if bits not in _schedule:
        n = MAX_CODE + 64
        entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)  # entries known when code k is read
        width = np.array([min(12, max(bits + 1, int(e).bit_length())) for e in entries], np.int64)
        _schedule[bits] = width, np.append(0, np.cumsum(width))
    return _schedule[bits]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW codes of samples under 2**bits, with a clear first, whenever the table is full, and an end code."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes: list[int] = []
    runs: list[int] = []
    full = MAX_CODE - 1
    samples = iter(data)
    cur = next(samples, None)
    put = codes.append
    more = True
    while more:
        put(clear)
        runs.append(len(codes))
        if cur is None:
            break
        table: dict[int, int] = {}
        size = end + 1
        more = False
        for b in samples:
            key = cur << 8 | b
            if key in table:
                cur = table[key]
            else:
                put(cur)
                table[key] = size
                size += 1
                cur = b
                if size == full:
                    more = True
                    break
        put(cur)
        if more:
            cur = next(samples, None)
            more = cur is not None
    codes.append(end)
    arr = np.array(codes, np.uint64)
    width, _ = _layout(bits)
    starts = np.array(runs)
    k = np.arange(len(arr))
    since = k - starts[np.maximum(np.searchsorted(starts, k, "right") - 1, 0)]
    w = width[np.maximum(since, 0)]
    # a clear code is read with the width that its place in the run before has
    for s in runs[1:]:
        w[s - 1] = width[s - 1 - starts[np.searchsorted(starts, s - 1, "right") - 1]]
    w[0] = bits + 1
    at = np.cumsum(w) - w
    total = int(at[-1] + w[-1])
    out = np.zeros(total // 8 + 4, np.uint8)
    shifted = arr << (at & 7).astype(np.uint64)
    byte = at >> 3
    for j in range(3):
        part = ((shifted >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
        if bits >= 7:  # codes of eight bits and more begin in different bytes
            out[byte + j] |= part
        else:
            out |= np.bincount(byte + j, part, len(out)).astype(np.uint8)  # bits don't overlap, so sums are unions
    return out[: (total + 7) // 8].tobytes()


def _strings(codes: np.ndarray, clear: int) -> bytes:
    """The samples of a run of codes after a clear, without a loop over codes.

    Entry i is the string of the run's code i and one sample more, so it is a slice of the output itself.
    Lengths and then source positions are found by pointer doubling.
    """
    m = len(codes)
    literal = codes < clear
    parent = np.where(literal, m, codes - (clear + 2))
    if (~literal & (parent >= np.arange(m))).any():
        raise ValueError("a code is not yet known")
    size, up = np.append(np.ones(m, np.int64), 0), np.append(parent, m)
    while (up < m).any():
        size = size + size[up]
        up = up[up]
    size = size[:m]
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(m), size)
    here = np.arange(len(owner))
    source = np.where(literal[owner], here, start[np.minimum(parent, m - 1)][owner] + here - start[owner])
    while True:
        far = source[source]
        if np.array_equal(far, source):
            return codes[owner[source]].astype(np.uint8).tobytes()
        source = far


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """Samples of a code stream, at most limit. Raises ValueError where a code cannot be."""
    clear, end = 1 << bits, (1 << bits) + 1
    width, offset = _layout(bits)
    buf = np.frombuffer(data + bytes(8), np.uint8)
    total, n = len(data) * 8, len(width)
    at, out, run = 0, [], []
    while True:
        late = bool(run)  # the table is full and no clear has come: widths stay at 12
        m = min(n, (total - at) // 12 if late else int(np.searchsorted(offset, total - at, "right")) - 1)
        codes = stop = np.empty(0, np.int64)
        if m > 0:
            pos = at + (np.arange(m) * 12 if late else offset[:m])
            w = np.full(m, 12) if late else width[:m]
            byte = pos >> 3
            word = buf[byte].astype(np.int64) | buf[byte + 1].astype(np.int64) << 8 | buf[byte + 2].astype(np.int64) << 16
            codes = (word >> (pos & 7)) & ((1 << w) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else m
        run.append(codes[: max(k, 0)])
        if k == m == n:
            at = int(pos[-1] + w[-1])
            continue
        part = np.concatenate(run)
        if len(part):
            out.append(_strings(part, clear))
        if k >= m or codes[k] == end:  # without an end code, what is there counts
            return b"".join(out)[:limit]
        at, run = int(pos[k] + w[k]), []


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


def payload_of(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def encode_gif(payload: bytes, delay: int = 4) -> bytes:
    """A GIF89a whose frames hold payload's bytes as samples, ROW a line."""
    lines = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(lines, MAX_LINES), 0xF7, 0, 0), _GREY]
    for i in range(0, lines, MAX_LINES):
        part = payload[i * ROW : (i + MAX_LINES) * ROW]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    number: int
    start_cs: int  #: hundredths of a second from the beginning
    delay_cs: int
    left: int
    top: int
    width: int
    height: int
    samples: bytes  #: palette indices, top to bottom
    canvas: np.ndarray | None  #: height x width x RGBA of the whole picture once the frame is drawn


def decode_gif(data: bytes, draw: bool = True):
    """The frames of a GIF in order. Raises ValueError where it is damaged."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at = 13
    palette = None

    def colours(n: int) -> np.ndarray:
        nonlocal at
        table = np.frombuffer(data[at : at + 3 * n], np.uint8)
        if len(table) < 3 * n:
            raise ValueError("a palette ends early")
        at += 3 * n
        return table.reshape(-1, 3)

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("a block ends early")
            n = data[at]
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
            if not n:
                return b"".join(parts)

    if flags & 0x80:
        palette = colours(2 << (flags & 7))
    canvas = np.zeros((height, width, 4), np.uint8) if draw else None
    delay, dispose, clear, clock, number = 0, 0, None, 0, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                dispose, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C or at + 9 > len(data):
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at : at + 9])
        at += 9
        own = colours(2 << (packed & 7)) if packed & 0x80 else palette
        bits = data[at] if at < len(data) else 0
        at += 1
        if not 1 <= bits <= 8:
            raise ValueError("a code size out of range")
        samples = lzw_decode(sub_blocks(), bits, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame ends early")
        if packed & 0x40:
            rows = np.frombuffer(samples, np.uint8).reshape(h, w)
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            whole = np.empty_like(rows)
            whole[order] = rows
            samples = whole.tobytes()
        shown = None
        if draw:
            if own is None:
                raise ValueError("no palette")
            before = canvas.copy() if dispose == 3 else None
            cut = np.frombuffer(samples, np.uint8).reshape(h, w)[: max(0, height - top), : max(0, width - left)]
            if cut.size and int(cut.max()) >= len(own) and (clear is None or (cut[cut != clear] >= len(own)).any()):
                raise ValueError("a sample has no colour")
            area = canvas[top : top + cut.shape[0], left : left + cut.shape[1]]
            if clear is None:
                area[..., :3], area[..., 3] = own[cut], 255
            else:
                seen = cut != clear
                area[seen, :3] = own[np.minimum(cut[seen], len(own) - 1)]
                area[seen, 3] = 255
            shown = canvas.copy()
            if dispose == 2:
                area[:] = 0
            elif dispose == 3:
                canvas = before
        yield Frame(number, clock, delay, left, top, w, h, samples, shown)
        clock, number = clock + delay, number + 1
        delay, dispose, clear = 0, 0, None
    raise ValueError("no trailer")


def histogram(canvas: np.ndarray) -> list[int]:
    """Counts of visible pixels by red, green and blue, BINS bins each."""
    shown = canvas[..., 3] > 0
    every = bool(shown.all())
    return np.concatenate([np.bincount(((x if every else x[shown]) >> 4).ravel(), minlength=BINS) for x in (canvas[..., c] for c in range(3))]).tolist()


_FRAMES = "number int, start_cs long, delay_cs int, width int, height int, visible long, samples binary, colours array<long>, error string"


def frames(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """A row for each frame of each GIF: its time, canvas size, palette samples and colour histogram; error for a damaged file."""
    small_batches(media.sparkSession)
    base = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("data"))

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column("media_id").to_pylist(), batch.column("data").to_pylist()):
                rows, error = [], None
                try:
                    for f in decode_gif(data or b""):
                        h, w = f.canvas.shape[:2]
                        rows.append({"media_id": key, "number": f.number, "start_cs": f.start_cs, "delay_cs": f.delay_cs, "width": w, "height": h, "visible": int((f.canvas[..., 3] > 0).sum()), "samples": f.samples, "colours": histogram(f.canvas), "error": None})
                except (ValueError, struct.error) as e:
                    error = str(e)
                if error or not rows:
                    rows.append({"media_id": key, "error": error or "no frames"})
                schema = pa.schema([("media_id", pa.int64()), ("number", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("visible", pa.int64()), ("samples", pa.binary()), ("colours", pa.list_(pa.int64())), ("error", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return base.mapInArrow(run, f"media_id long, {_FRAMES}")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64())])


def store_and_read(data: bytes) -> tuple:
    """Stores a text's bytes as a GIF, reads the pixels of the drawn frames back and measures them.

    feature: start:delay:histogram of each timed frame, joined by semicolons. The grey palette makes a pixel's red its byte."""
    gif = encode_gif(payload_of(data))
    read, shown = [], []
    for f in decode_gif(gif):
        read.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
        shown.append(f"{f.start_cs}:{f.delay_cs}:{','.join(map(str, histogram(f.canvas)))}")
    back = b"".join(read)
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(gif), hashlib.sha256(gif).hexdigest(), ";".join(shown), len(shown)


def _store(batches):
    for batch in batches:
        seen: dict[bytes, tuple] = {}
        rows = []
        for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if data not in seen:
                seen[data] = store_and_read(data)
            rows.append((key, *seen[data]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long")


def op7_gif_media(spark, sf_dir) -> DataFrame:
    return texts_as_media(table(spark, sf_dir, "documents"))
