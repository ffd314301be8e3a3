"""Reversible transforms of byte strings, and their estimated gains: numpy and plain Python per object, applied in Arrow batches.

encode() and decode() apply a transform by name to a binary column; estimate_gains() scores all of them.
Frames are this library's own. An object is one row, so memory follows the largest object.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import pieces, small_batches
from .profile import _PRINTABLE, _entropy, dominant, looks_like_floats, mean_run, mean_step, plane_width, record_width, repeat_ratio


def _arr(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number ends early")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def delta_bytes(data: bytes) -> bytes:
    a = _arr(data)
    return np.concatenate([a[:1], (a[1:] - a[:-1]).astype(np.uint8)]).tobytes()


def undelta_bytes(data: bytes) -> bytes:
    return np.cumsum(_arr(data), dtype=np.uint8).tobytes()


def transpose(data: bytes, width: int) -> bytes:
    """Bytes of all records' first column, then of the second, and so on. The length is a multiple of width."""
    if width < 1 or len(data) % width:
        raise ValueError("length is no multiple of the width")
    return _arr(data).reshape(-1, width).T.tobytes()


def untranspose(data: bytes, width: int) -> bytes:
    return _arr(data).reshape(width, -1).T.tobytes()


def rle(data: bytes) -> bytes:
    a = _arr(data)
    if not len(a):
        return b""
    at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n = np.diff(np.append(at, len(a)))
    pairs, out, done = np.stack([a[at], n.astype(np.uint8)], axis=1), [], 0
    for i in np.flatnonzero(n >= 128).tolist():  # lengths of more than one byte
        out += [pairs[done:i].tobytes(), bytes([a[at[i]]]), varint(int(n[i]))]
        done = i + 1
    return b"".join([*out, pairs[done:].tobytes()])


def unrle(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n, end = read_varint(data, at + 1)
        out.append(data[at : at + 1] * n)
        at = end
    return b"".join(out)


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix order by prefix doubling on ranks; a shorter suffix sorts first."""
    n = len(data)
    rank = _arr(data).astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] if k < n else 0
        order = np.lexsort((second, rank))
        new = np.ones(n, np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        k *= 2


def bwt(data: bytes) -> tuple[bytes, int]:
    """Last column of the sorted suffixes with an end mark, without the mark, and the mark's row."""
    if not data:
        return b"", 0
    order = np.append(len(data), suffix_array(data))
    mark = int(np.flatnonzero(order == 0)[0])
    return np.delete(_arr(data)[order - 1], mark).tobytes(), mark


def unbwt(data: bytes, mark: int) -> bytes:
    n = len(data)
    if not n:
        return b""
    last = np.insert(_arr(data).astype(np.int16), mark, -1)
    step = np.argsort(last, kind="stable").tolist()
    column, out, at = last.tolist(), bytearray(), mark
    for _ in range(n):
        at = step[at]
        out.append(column[at])
    return bytes(out)


def mtf(data: bytes) -> bytes:
    symbols, out = list(range(256)), bytearray()
    for b in data:
        i = symbols.index(b)
        out.append(i)
        if i:
            del symbols[i]
            symbols.insert(0, b)
    return bytes(out)


def unmtf(data: bytes) -> bytes:
    symbols, out = list(range(256)), bytearray()
    for i in data:
        b = symbols.pop(i)
        out.append(b)
        symbols.insert(0, b)
    return bytes(out)


def bwt_chain(data: bytes) -> bytes:
    last, mark = bwt(data)
    return struct.pack("<I", mark) + rle(mtf(last))


def unbwt_chain(data: bytes) -> bytes:
    return unbwt(unmtf(unrle(data[4:])), struct.unpack_from("<I", data)[0])


CONTEXT = np.repeat([0, 1, 2, 3], [32, 64, 32, 128])


def previous_class(data: bytes) -> np.ndarray:
    """Class of the byte before: control, printable, high ASCII, beyond; 0 for the first."""
    return np.append(0, CONTEXT[_arr(data)[:-1]])[: len(data)]


def byte_classes(data: bytes) -> np.ndarray:
    """0 structure, 1 text, 2 digits, 3 other, with a state for quoted strings: in quotes all but the closing quote is text."""
    kind = np.full(256, 3)
    kind[list(b"{}[]()<>,:;=\"'/|\n\r\t ")] = 0
    kind[list(range(65, 91)) + list(range(97, 123)) + [95, 45]] = 1
    kind[list(range(48, 58)) + [43, 46]] = 2
    plain = kind.tolist()
    out, quoted, escaped = [], False, False
    for b in data:
        if quoted:
            if escaped:
                escaped = False
                out.append(1)
            elif b == 92:
                escaped = True
                out.append(1)
            elif b == 34:
                quoted = False
                out.append(0)
            else:
                out.append(1)
        else:
            quoted = b == 34
            out.append(plain[b])
    return np.array(out, np.int64)


def split_streams(data: bytes, classes: np.ndarray, k: int = 4) -> list[bytes]:
    a = _arr(data)
    return [a[classes == c].tobytes() for c in range(k)]


def _frame(parts: list[bytes]) -> bytes:
    return b"".join(varint(len(p)) + p for p in parts)


def _unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n, at = read_varint(data, at)
        out.append(data[at : at + n])
        at += n
    return out


def condition(data: bytes) -> bytes:
    """Four class streams and the run-length map of classes by position."""
    c = byte_classes(data)
    return _frame([rle(c.astype(np.uint8).tobytes()), *split_streams(data, c)])


def uncondition(data: bytes) -> bytes:
    places, *streams = _unframe(data)
    c = _arr(unrle(places))
    out = np.empty(len(c), np.uint8)
    for k, s in enumerate(streams):
        out[c == k] = _arr(s)
    return out.tobytes()


def conditioned_bwt(data: bytes, least: int = 128) -> bytes:
    """Class streams of 128 bytes and more go through the chain, others stay."""
    c = byte_classes(data)
    parts = [b"\1" + bwt_chain(s) if len(s) >= least else b"\0" + s for s in split_streams(data, c)]
    return _frame([rle(c.astype(np.uint8).tobytes()), *parts])


def unconditioned_bwt(data: bytes) -> bytes:
    places, *parts = _unframe(data)
    return uncondition(_frame([places, *(unbwt_chain(p[1:]) if p[:1] == b"\1" else p[1:] for p in parts)]))


def context_split(data: bytes) -> bytes:
    return _frame(split_streams(data, previous_class(data)))


def uncontext_split(data: bytes) -> bytes:
    streams = [iter(s) for s in _unframe(data)]
    out, c, table = bytearray(), 0, CONTEXT.tolist()
    while (b := next(streams[c], None) if streams else None) is not None:
        out.append(b)
        c = table[b]
    return bytes(out)


def _guess(prev: np.ndarray, data: np.ndarray) -> dict[int, int]:
    """The commonest byte (smaller on ties) after each two-byte context."""
    pair = (prev.astype(np.int64) << 8) | data
    v, n = np.unique(pair, return_counts=True)
    best: dict[int, tuple[int, int]] = {}
    for x, k in zip(v.tolist(), n.tolist()):
        if x >> 8 not in best or k > best[x >> 8][0]:
            best[x >> 8] = (k, x & 255)
    return {c: b for c, (_, b) in best.items()}


def _context2(data: bytes) -> tuple[bytes, dict[int, int]]:
    a = _arr(data)
    before = (np.concatenate([[0, 0], a])[: len(a)].astype(np.int64) << 8) | np.concatenate([[0], a])[: len(a)]
    table = _guess(before, a)
    best = np.zeros(1 << 16, np.uint8)
    best[list(table)] = list(table.values())
    guess = best[before]
    return (a - guess).astype(np.uint8).tobytes(), table


def residuals(data: bytes) -> dict[str, bytes]:
    a = _arr(data)
    return {"delta1": delta_bytes(data), "delta2": _delta2(a), "context2": _context2(data)[0]}


def _delta2(a: np.ndarray) -> bytes:
    return (a - np.concatenate([[0, 0], a])[: len(a)].astype(np.uint8)).astype(np.uint8).tobytes()


def predict(data: bytes) -> bytes:
    """Residuals of the predictor whose entropy on the first 1024 bytes is least (earlier on ties)."""
    head = {k: _entropy(np.bincount(_arr(v), minlength=256)) for k, v in residuals(data[:1024]).items()}
    names = list(head)
    name = min(names, key=lambda k: head[k])
    if name == "context2":
        rest, table = _context2(data)
        return b"\2" + _frame([b"".join(struct.pack("<HB", c, b) for c, b in sorted(table.items())), rest])
    return bytes([names.index(name)]) + (delta_bytes(data) if name == "delta1" else _delta2(_arr(data)))


def unpredict(data: bytes) -> bytes:
    body = data[1:]
    if data[0] == 0:
        return undelta_bytes(body)
    if data[0] == 1:
        out = _arr(body).copy()
        for k in range(2):
            out[k::2] = np.cumsum(out[k::2], dtype=np.uint8)
        return out.tobytes()
    rows, rest = _unframe(body) if body else (b"", b"")
    table = {c: b for c, b in struct.iter_unpack("<HB", rows)}
    out, context = bytearray(), 0
    for r in rest:
        b = r + table[context] & 255
        out.append(b)
        context = (context << 8 | b) & 0xFFFF
    return bytes(out)


def const_elim(data: bytes) -> bytes:
    """The dominant byte, a bitmap of the others' places and the others."""
    b, _ = dominant(data)
    off = _arr(data) != b
    return bytes([b]) + varint(len(data)) + np.packbits(off).tobytes() + _arr(data)[off].tobytes()


def unconst_elim(data: bytes) -> bytes:
    n, at = read_varint(data, 1)
    k = -(-n // 8)
    off = np.unpackbits(_arr(data[at : at + k]), count=n).astype(bool)
    out = np.full(n, data[0], np.uint8)
    out[off] = _arr(data[at + k :])
    return out.tobytes()


def stride_elim(data: bytes) -> bytes:
    """Little-endian integers that follow a line: start, step and deviations, at the first width of 8, 4, 2, 1 with a tenth or fewer."""
    for w in (8, 4, 2, 1):
        n = len(data) // w
        if n < 8 or len(data) % w:
            continue
        x = np.frombuffer(data, f"<u{w}")
        line = x[:1] + np.arange(n, dtype=x.dtype) * (x[1:2] - x[:1])  # wraps, as arrays do
        off = np.flatnonzero(x != line)
        if len(off) * 10 <= n:
            return bytes([w]) + varint(n) + x[:2].tobytes() + off.astype("<u4").tobytes() + x[off].tobytes()
    return b"\0" + data


def unstride_elim(data: bytes) -> bytes:
    w = data[0]
    if not w:
        return data[1:]
    n, at = read_varint(data, 1)
    head = np.frombuffer(data, f"<u{w}", 2, at)
    k = (len(data) - at - 2 * w) // (4 + w)
    off = np.frombuffer(data, "<u4", k, at + 2 * w)
    out = head[:1] + np.arange(n, dtype=head.dtype) * (head[1:] - head[:1])
    out[off] = np.frombuffer(data, f"<u{w}", k, at + 2 * w + 4 * k)
    return out.tobytes()


def field_lz(data: bytes, width: int = 4, window: int = 65_535) -> bytes:
    """Fixed-width fields: 0 and a new field, or the distance to its last occurrence within the window."""
    last: dict[bytes, int] = {}
    out = [bytes([width]), varint(len(data))]
    whole = len(data) - len(data) % width
    for i in range(0, whole, width):
        f = data[i : i + width]
        k = last.get(f)
        d = (i - k) // width if k is not None else 0
        out.append(varint(d) if 0 < d <= window else b"\0" + f)
        last[f] = i
    return b"".join(out) + data[whole:]


def unfield_lz(data: bytes) -> bytes:
    width = data[0]
    n, at = read_varint(data, 1)
    out = bytearray()
    while len(out) < n - n % width:
        d, at = read_varint(data, at)
        if d:
            i = len(out) - d * width
            out += out[i : i + width]
        else:
            out += data[at : at + width]
            at += width
    return bytes(out + data[at:])


def rolz(data: bytes, slots: int = 64) -> bytes:
    """LZ with matches (3..255) looked for only among the last places that followed the same byte; a search stops at 32."""
    places: list[list[int]] = [[] for _ in range(256)]
    out, i, literals = [varint(len(data))], 0, bytearray()

    def flush() -> None:
        if literals:
            out.append(b"\0" + varint(len(literals)) + bytes(literals))
            literals.clear()

    def note(j: int) -> None:
        if j:
            p = places[data[j - 1]]
            p.append(j)
            if len(p) > slots:
                del p[0]

    while i < len(data):
        best, where = 0, 0
        if i:
            for back, j in enumerate(reversed(places[data[i - 1]])):
                n = 0
                while n < 255 and i + n < len(data) and data[j + n] == data[i + n]:
                    n += 1
                if n > best:
                    best, where = n, back
                    if n >= 32:
                        break
        if best >= 3:
            flush()
            out.append(bytes([best, where]))
        else:
            best = 1
            literals.append(data[i])
        for j in range(i, i + best):
            note(j)
        i += best
    flush()
    return b"".join(out)


def unrolz(data: bytes, slots: int = 64) -> bytes:
    n, at = read_varint(data, 0)
    places: list[list[int]] = [[] for _ in range(256)]
    out = bytearray()

    def put(b: int) -> None:
        if out:
            p = places[out[-1]]
            p.append(len(out))
            if len(p) > slots:
                del p[0]
        out.append(b)

    while len(out) < n:
        k = data[at]
        if k == 0:
            m, at = read_varint(data, at + 1)
            for b in data[at : at + m]:
                put(b)
            at += m
        else:
            j = places[out[-1]][-1 - data[at + 1]]
            for d in range(k):
                put(out[j + d])
            at += 2
    return bytes(out)


def float_split(data: bytes) -> bytes:
    """32-bit floats as a stream of exponents and one of signs with fractions."""
    u = np.frombuffer(data[: len(data) // 4 * 4], "<u4")
    sign = (u >> 31 << 23 | u & 0x7FFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return varint(len(u)) + (u >> 23 & 0xFF).astype(np.uint8).tobytes() + sign.tobytes() + data[len(u) * 4 :]


def unfloat_split(data: bytes) -> bytes:
    n, at = read_varint(data, 0)
    e = _arr(data[at : at + n]).astype("<u4")
    s = np.zeros((n, 4), np.uint8)
    s[:, :3] = _arr(data[at + n : at + 4 * n]).reshape(n, 3)
    s = s.view("<u4").ravel()
    return ((s >> 23 & 1) << 31 | e << 23 | s & 0x7FFFFF).astype("<u4").tobytes() + data[at + 4 * n :]


def normalize(data: bytes) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Without white space between JSON tokens (outside strings), or between XML tags; and the cuts (place in the result, bytes). The shorter of both."""
    def cut(spots: list[tuple[int, int]]):
        out, diffs, at = bytearray(), [], 0
        for a, b in spots:
            out += data[at:a]
            diffs.append((len(out), data[a:b]))
            at = b
        return bytes(out + data[at:]), diffs

    json, spots, quoted, escaped, i = data.lstrip()[:1] in (b"{", b"["), [], False, False, 0
    while json and i < len(data):
        b = data[i]
        if quoted:
            escaped, quoted = (b == 92 and not escaped), not (b == 34 and not escaped)
        elif b == 34:
            quoted = True
        elif b in b" \t\r\n":
            j = i
            while j < len(data) and data[j] in b" \t\r\n":
                j += 1
            spots.append((i, j))
            i = j
            continue
        i += 1
    json_like = cut(spots)
    spots, i = [], data.find(b">")
    while i >= 0:
        j = i + 1
        while j < len(data) and data[j] in b" \t\r\n":
            j += 1
        if j > i + 1 and data[j : j + 1] == b"<":
            spots.append((i + 1, j))
        i = data.find(b">", i + 1)
    xml_like = cut(spots)
    return json_like if json and len(json_like[0]) < len(xml_like[0]) else xml_like


def denormalize(data: bytes, diffs: list[tuple[int, bytes]]) -> bytes:
    out, at = [], 0
    for i, x in diffs:
        out += [data[at:i], x]
        at = i
    return b"".join([*out, data[at:]])


def _normalize(data: bytes) -> bytes:
    short, diffs = normalize(data)
    return _frame([short, *(varint(i) + x for i, x in diffs)])


def _denormalize(data: bytes) -> bytes:
    short, *diffs = _unframe(data)
    pairs = []
    for d in diffs:
        i, at = read_varint(d, 0)
        pairs.append((i, d[at:]))
    return denormalize(short, pairs)


def _planes(data: bytes) -> bytes:
    w = (plane_width(data) or (1,))[0]
    return bytes([w]) + transpose(data, w)


def _records(data: bytes) -> bytes:
    w = (record_width(data) or (1,))[0]
    return bytes([w]) + transpose(data, w)


def _unplanes(data: bytes) -> bytes:
    return untranspose(data[1:], data[0])


#: name -> (encode, decode)
TRANSFORMS: dict[str, tuple[Callable, Callable]] = {
    "delta": (delta_bytes, undelta_bytes), "transpose": (_records, _unplanes), "byte_plane": (_planes, _unplanes), "rle": (rle, unrle), "bwt_chain": (bwt_chain, unbwt_chain), "mtf": (mtf, unmtf),
    "conditioned_bwt": (conditioned_bwt, unconditioned_bwt), "condition": (condition, uncondition), "context_split": (context_split, uncontext_split), "predict": (predict, unpredict),
    "const_elim": (const_elim, unconst_elim), "stride_elim": (stride_elim, unstride_elim), "field_lz": (field_lz, unfield_lz), "rolz": (rolz, unrolz), "float_split": (float_split, unfloat_split), "normalize": (_normalize, _denormalize),
}


def apply(df: DataFrame, col: str, name: str, inverse: bool = False, out: str = "encoded") -> DataFrame:
    """df with the transform (or its inverse) of a binary or string column; nulls stay null."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    f = TRANSFORMS[name][inverse]
    small_batches(df.sparkSession)

    def run(batches):
        for batch in pieces(batches, col):
            cells = [None if x is None else f(x) if x else b"" for x in batch.column(col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema, StructField(out, BinaryType())]))


def gains(data: bytes) -> dict[str, float]:
    """Scores of the transforms whose gate the object passes."""
    n = len(data)
    if not n:
        return {}
    c = np.bincount(_arr(data), minlength=256)
    h, a = _entropy(c), float(c[_PRINTABLE].sum() / n)
    out: dict[str, float] = {}
    if h <= 6 and n >= 32 and (m := mean_step(data)) < 30:
        out["delta"] = 30 - m
    if h <= 7 and a <= 0.85:
        if r := record_width(data):
            out["transpose"] = 0.5 * r[0]
        if p := plane_width(data):
            out["byte_plane"] = 0.8 * p[0]
    if (h >= 4.5 if a > 0.85 else h >= 3) and h <= 7 and n >= 512:
        out["rolz"] = 7 - h
    if h <= 6.5 and a <= 0.85 and looks_like_floats(data):
        out["float_split"] = 3.0
    if r := next((r for w in (4, 8, 2) if (r := repeat_ratio(data, w)) > 0.3), None):
        out["field_lz"] = 5 * r
    if n >= 64 and (r := mean_run(data)) >= 4:
        out["rle"] = 2 * r
    white = int(c[[9, 10, 13, 32]].sum()) / n
    if n >= 128 and a >= 0.8 and white > 0.05:
        out["normalize"] = white * n
    if 256 <= n <= 64 << 20 and a > 0.7 and h < 6:
        out["bwt_chain"] = 5 * a
    if n >= 256 and 0.3 < a < 0.9 and h > 4:
        out["context_split"] = 2.0
    b, share = dominant(data)
    saving = n - (9 + -(-n // 8) + n - int(c[b]))
    if n >= 64 and share >= 0.9 and saving > 0:
        out["const_elim"] = 10 * saving / n
    if n >= 256 and 2 < h < 7 and a > 0.5:
        out["condition"] = h / 8 * a * 3
    if n >= 64 and 1 < h < 6.5:
        better = h - min(_entropy(np.bincount(_arr(v), minlength=256)) for v in residuals(data[:1024]).values())
        if better > 0.5:
            out["predict"] = 2 * better
    if n >= 512 and 2 < h < 6.5 and a > 0.5:
        out["conditioned_bwt"] = 4 * a * (1 - h / 8)
    return out


def estimate_gains(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, transform, gain, place: candidates by gain, then name."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            rows = [(k, name, g, i + 1) for k, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) for i, (name, g) in enumerate(sorted(gains(data or b"").items(), key=lambda x: (-x[1], x[0])))]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema[0].type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], names=[id_col, "transform", "gain", "place"])

    return df.select(id_col, F.col(col)).mapInArrow(run, f"{id_col} {kind}, transform string, gain double, place int")
