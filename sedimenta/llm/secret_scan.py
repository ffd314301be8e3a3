"""Secret spans: fixed rules, and a character convolutional network over every other candidate.

Rules give spans of kinds assign, access and hex. All other runs of at least CANDIDATE characters of the
secret alphabet are candidates; each goes, with its surrounding context, through a small convolutional
network in numpy. The network sees HEAD + TAIL characters at once, so it slides over longer candidates, STEP at a
time, and over their parts between separators; a candidate's score is its highest. The network is trained on
the driver on labelled findings (labelled_findings(): TRAIN seeded examples of credentials and of look-alikes in
context), its scores are calibrated on a held-out part, and the threshold is the highest that keeps RECALL of the held-out
secrets. Candidates over it are added as kind model unless the rules' spans cover them whole. The weights are a few
thousand numbers; the scan itself shuffles nothing.

Whole texts are scanned: runs come from one vectorised pass over the bytes, and rules run only where their
letters occur. Positions are code points.

Nulls and edge cases: a null text counts as empty; candidates of any length are scored whole, a bounded number of
windows at a time; spans of equal start are ordered by kind; repeated rows give equal rows; extra columns are ignored by scan() and kept by redact(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, table, text_or_empty

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
CANDIDATE, TRAIN, RECALL, SEED = 16, 6000, 0.97, 5
HEAD, TAIL, LEFT, RIGHT, STEP, CHUNK = 32, 16, 24, 8, 16, 4096
WIDTH, EMBED, FILTERS = 5, 10, 24
_SECRET = np.zeros(256, bool)
_SECRET[list(b"+/_.=-" + string.ascii_letters.encode() + string.digits.encode())] = True
_PART = _SECRET.copy()
_PART[list(b"+/.=")] = False  #: what a part between separators is made of
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def runs(data: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of maximal runs of members with at least least bytes."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = member[data]
    edge = np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2)
    return edge[edge[:, 1] - edge[:, 0] >= least]


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' findings, in code points."""
    data = text.encode() if data is None else data
    found = []
    low = data.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    buf = np.frombuffer(data, np.uint8)
    found += [(a, 2, b) for a, b in _points(buf, runs(buf, _HEX, 32), len(data) == len(text)).tolist()]
    return found


def _points(buf: np.ndarray, spans: np.ndarray, plain: bool) -> np.ndarray:
    """Byte positions as code points."""
    if plain or not len(spans):
        return spans
    before = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    return before[spans]


# --- labelled findings -------------------------------------------------------------------------------


def labelled_findings(n: int = TRAIN, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): half credentials of many makes, half ordinary long runs, in context."""
    r = random.Random(seed)
    letters, digits, mixed = string.ascii_lowercase, string.digits, string.ascii_letters + string.digits
    parts = "tion er an en ing re st ver ich ent que ment os ado ar lich ung the ou ble ness con pro inter al is ka mo li su ta ge".split()
    parts += "schaft heit keit zu pf tz sch ck chts bahn stell auf ein unter eur eaux aise oire esse ista ador mente cion ncia str spr nk lt rz ph gh ght wr dge xt".split()
    pick = lambda abc, k: "".join(r.choice(abc) for _ in range(k))

    def word(least: int = 2) -> str:
        w = ""
        while len(w) < least:
            w += r.choice(parts) if r.random() < 0.9 else r.choice(letters)
        return r.choice([w, w, w.capitalize(), w.upper()]) if least > 8 else w

    def secret() -> str:
        k = r.randrange(9)
        if k == 8:  # within a path
            path = lambda: "/".join(word(3) for _ in range(r.randint(1, 6)))
            return f"{path()}/{pick(mixed, r.randint(24, 48))}/{path()}"
        if k == 0:
            return pick(mixed, r.randint(20, 64))
        if k == 1:
            return pick(mixed + "+/", r.randint(24, 88)) + "=" * r.randint(0, 2)
        if k == 2:
            return r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_", "AIza", "SG."]) + pick(mixed + "_-", r.randint(20, 40))
        if k == 3:
            return "eyJ" + pick(mixed + "_-", 30) + "." + pick(mixed + "_-", 40) + "." + pick(mixed + "_-", 43)
        if k == 4:
            return pick("0123456789abcdef", r.randint(20, 31))
        if k == 5:
            return "ASIA" + pick(string.ascii_uppercase + digits, 16)
        if k == 6:
            return pick(string.ascii_uppercase + digits, r.randint(20, 40))
        return pick(letters + digits, r.randint(20, 40))

    def plain() -> str:
        k = r.randrange(13)
        if k > 9:
            host = f"{word(3)}{r.randint(0, 30)}.{word(4)}.{r.choice(['com', 'org', 'net', 'de'])}".lower()
            return host if k > 10 else f"{word(3)}.{r.randint(1, 99)}" + "-" + host
        if k < 4:
            return word(r.randint(CANDIDATE, 30))
        if k == 4:
            return "-".join(word(3) for _ in range(r.randint(4, 8)))
        if k == 5:
            return "_".join(word(3) for _ in range(r.randint(4, 8)))
        if k == 6:
            return "/".join(word(3) for _ in range(r.randint(4, 8))) + r.choice([".html", ".py", "", "/"])
        if k == 7:
            return r.choice("=-_.") * r.randint(16, 60)
        if k == 8:
            return ".".join(word(3) for _ in range(r.randint(4, 7)))
        return pick(digits, r.randint(16, 22))

    out = []
    for i in range(n):
        label = i % 2
        mid = secret() if label else plain()
        mid = mid if len(mid) >= CANDIDATE else mid + word(CANDIDATE)
        left = " ".join(word() for _ in range(r.randint(0, 8)))
        if label and r.random() < 0.5:
            left += r.choice([" key", " auth", " credential", " Bearer", " pwd", " client", " private"]) + r.choice([" = ", ": ", "=", " is ", ' "'])
        else:
            left += r.choice([" ", " ", " ", " (", ", ", '"', "\n", " a.b1@", " name@", " http://", " é", "ß"]) if left else ""
        right = r.choice([" ", ". ", '" ', "\n", ""]) + " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((left + mid + (right if right[:1] in (" ", '"', "\n", "") or not right else " " + right), len(left), len(left) + len(mid), label))
    order = list(range(n))
    r.shuffle(order)
    return [out[i] for i in order]


# --- network -----------------------------------------------------------------------------------------

LENGTH = LEFT + HEAD + TAIL + RIGHT


def _codes(data: bytes, spans: np.ndarray) -> np.ndarray:
    """A row of symbols for each byte span: left context, its head and its tail, right context. 0 is padding, 127 any other byte."""
    pad = LEFT + HEAD
    buf = np.zeros(len(data) + 2 * pad, np.uint8)
    raw = np.frombuffer(data, np.uint8)
    buf[pad : pad + len(data)] = np.where(raw < 127, np.maximum(raw, 1), 127)
    s, e = spans[:, :1] + pad, spans[:, 1:] + pad
    head = s + np.arange(HEAD)
    tail = e - TAIL + np.arange(TAIL)
    left, right = s - LEFT + np.arange(LEFT), e + np.arange(RIGHT)
    out = buf[np.concatenate([left, np.minimum(head, len(buf) - 1), tail, right], axis=1)]
    inside = np.concatenate([head < e, tail >= np.maximum(s, s + HEAD)], axis=1)
    out[:, LEFT : LEFT + HEAD + TAIL][~inside] = 0
    return out


def windows(data: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that the network looks at, and the number of the candidate of each: whole short candidates, windows of long ones, and parts between separators."""
    wide, size = HEAD + TAIL, spans[:, 1] - spans[:, 0]
    n = np.where(size > wide, -(-(size - wide) // STEP) + 1, 1)
    owner = np.repeat(np.arange(len(spans)), n)
    start = spans[owner, 0] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    start = np.minimum(start, np.maximum(spans[owner, 1] - wide, spans[owner, 0]))
    out = np.stack([start, np.minimum(start + wide, spans[owner, 1])], axis=1)
    parts = runs(np.frombuffer(data, np.uint8), _PART, CANDIDATE)
    of = np.searchsorted(spans[:, 0], parts[:, 0], "right") - 1
    inside = (of >= 0) & (parts[:, 1] <= spans[of, 1]) & (parts[:, 1] - parts[:, 0] < size[of]) & (parts[:, 1] - parts[:, 0] <= wide)
    return np.concatenate([out, parts[inside]]), np.append(owner, of[inside])


def candidate_scores(model: dict, data: bytes, spans: np.ndarray) -> np.ndarray:
    """The highest score of each candidate's windows."""
    best = np.zeros(len(spans))
    if len(spans):
        seen, owner = windows(data, spans)
        for i in range(0, len(seen), CHUNK):
            np.maximum.at(best, owner[i : i + CHUNK], score(model, _codes(data, seen[i : i + CHUNK])))
    return best


def _forward(w: dict, codes: np.ndarray):
    x = w["embed"][codes]  # examples x LENGTH x EMBED
    cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), LENGTH - WIDTH + 1, WIDTH * EMBED)
    z = cols @ w["conv"] + w["bias"]
    a = np.maximum(z, 0)
    top, mean = a.max(axis=1), a.mean(axis=1)
    h = np.concatenate([top, mean], axis=1)
    return h @ w["out"] + w["off"], (cols, z, a, h)


def train(codes: np.ndarray, labels: np.ndarray, epochs: int = 10, rate: float = 0.01, seed: int = SEED) -> dict:
    """Adam on the logistic loss, in single precision."""
    g = np.random.Generator(np.random.PCG64(seed))
    f = lambda *shape, s: (g.standard_normal(shape) * s).astype(np.float32)
    w = {"embed": f(128, EMBED, s=0.5), "conv": f(WIDTH * EMBED, FILTERS, s=0.15), "bias": np.zeros(FILTERS, np.float32), "out": f(2 * FILTERS, s=0.2), "off": np.zeros(1, np.float32)}
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(epochs):
        order = g.permutation(len(codes))
        for at in range(0, len(order), 128):
            i = order[at : at + 128]
            c, y = codes[i], labels[i]
            logit, (cols, z, a, h) = _forward(w, c)
            d = (1 / (1 + np.exp(-logit)) - y).astype(np.float32) / len(i)
            grad = {"out": h.T @ d, "off": d.sum(keepdims=True)}
            dh = np.outer(d, w["out"])
            da = np.repeat(dh[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
            np.put_along_axis(da, a.argmax(axis=1)[:, None, :], np.take_along_axis(da, a.argmax(axis=1)[:, None, :], 1) + dh[:, None, :FILTERS], axis=1)
            dz = da * (z > 0)
            grad["conv"] = np.einsum("npc,npf->cf", cols, dz, optimize=True)
            grad["bias"] = dz.sum(axis=(0, 1))
            dx = np.zeros((len(i), LENGTH, EMBED), np.float32)
            dc = (dz @ w["conv"].T).reshape(len(i), -1, WIDTH, EMBED)
            for k in range(WIDTH):
                dx[:, k : k + dc.shape[1]] += dc[:, :, k]
            grad["embed"] = np.zeros_like(w["embed"])
            np.add.at(grad["embed"], c.ravel(), dx.reshape(-1, EMBED))
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on the logits, by Newton steps with a small ridge."""
    b = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], axis=1).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.linalg.solve(hess, x.T @ (p - y) + 1e-3 * (b - [1, 0]))
    return float(b[0]), float(b[1])


def score(model: dict, codes: np.ndarray) -> np.ndarray:
    """Calibrated probabilities."""
    out = [_forward(model["weights"], codes[i : i + 256])[0] for i in range(0, len(codes), 256)]
    logit = np.concatenate(out) if out else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * logit + model["offset"], -30, 30)))


@lru_cache(maxsize=4)
def fitted(n: int = TRAIN, recall: float = RECALL, seed: int = SEED) -> dict:
    """Weights, calibration and threshold; the last third of the findings is held out for the latter two."""
    found = [(t.encode(), len(t[:a].encode()), len(t[:b].encode()), y) for t, a, b, y in labelled_findings(n, seed)]
    y = np.array([x[3] for x in found], np.float32)
    cut = n * 2 // 3
    # windows of look-alikes are look-alikes; of a secret's, the one that looks most like one to a first network
    seen = [windows(t, np.array([[a, b]]))[0] for t, a, b, _ in found[:cut]]
    codes = np.concatenate([_codes(t, w) for (t, *_), w in zip(found, seen)])
    owner = np.repeat(np.arange(cut), [len(w) for w in seen])
    whole = np.flatnonzero((y[owner] == 0) | (np.bincount(owner)[owner] == 1))
    weights = train(codes[whole], y[owner[whole]], epochs=4)
    z = _forward(weights, codes)[0]
    top = np.full(cut, -np.inf)
    np.maximum.at(top, owner, z)
    kept = np.flatnonzero((y[owner] == 0) | (z >= top[owner]))
    model = {"weights": train(codes[kept], y[owner[kept]]), "slope": 1.0, "offset": 0.0}
    p = np.concatenate([candidate_scores(model, t, np.array([[a, b]])) for t, a, b, _ in found[cut:]])
    p = np.clip(p, 1e-9, 1 - 1e-9)
    model["slope"], model["offset"] = _platt(np.log(p / (1 - p)), y[cut:])
    p = np.sort(np.concatenate([candidate_scores(model, t, np.array([[a, b]])) for t, a, b, k in found[cut:] if k]))
    model["threshold"] = float(p[int((1 - recall) * len(p))])
    return model


def spans_of(text: str, model: dict | None) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end), by start and kind."""
    data = text.encode()
    found = base_spans(text, data)
    if model is not None:
        buf = np.frombuffer(data, np.uint8)
        candidates = runs(buf, _SECRET, CANDIDATE)
        if len(candidates):
            p = candidate_scores(model, data, candidates)
            rules = sorted((x, y) for x, _, y in found)
            for a, b in _points(buf, candidates[p >= model["threshold"]], len(data) == len(text)).tolist():
                at = a
                for x, y in rules:  # what the rules leave of it
                    at = max(at, y) if x <= at else at
                if at < b:
                    found.append((a, 3, b))
    return sorted(found)


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans of every whole text."""
    model = model or fitted()
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = spans_of(text, model)
                kinds = [k for _, k, _ in spans]
                rule = _named(s for s in spans if s[1] < 3)
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(rule.encode()).hexdigest(), _named(spans)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=names)

    return base.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def masked(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", model: dict | None = None) -> DataFrame:
    """docs' rows with each run of overlapping spans of the text replaced by mask; null texts stay null."""
    model = model or fitted()
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            new = [None if t is None else masked(t, spans_of(t, model), mask) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
        release()

    return docs.mapInArrow(run, schema)


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
