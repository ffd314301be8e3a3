"""Language identification by interpolated Kneser-Ney character models.

One model a language, of ORDER characters, kept as sorted arrays of 64-bit n-gram hashes with their probabilities
and of context hashes with their back-off weights. Letters are lower-cased and each is a symbol of its own
(its code point; the few thousand letters above U+FFFF share 2048 symbols); runs of other characters are one
boundary. The hash of a packed n-gram is one to one, so no two n-grams share a place. Each order has its own
discount, from its counts of one and two. A text goes to the language of the lowest cross-entropy a symbol.

The models are fitted on a bounded sample of rows, DOCS_EACH texts a language (those of the least md5 of doc_id
among the training rows). Their n-grams are counted by Spark over whole texts; only counts reach the driver. A tenth of
the texts is held back: WINDOWS windows spread over each of them calibrate the score's temperature, and each
language's rejection limit, the REJECT quantile of its cross-entropies, which `accepted` applies. Prediction is one pass
without a shuffle. A worker keeps the n-grams that it met last in a table of fixed size.

Nulls and edge cases: a null text, or one without letters, is `und` with score 0; where nothing can be learned
all are; of languages with equal cross-entropy the first by name is taken; rows that repeat a doc_id and its text
are each learned from and predicted alike; rows with a null lang are not learned from; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Tables, small_batches, table, text_or_empty

ORDER, DISCOUNT = 4, 0.75  #: DISCOUNT is for orders without n-grams seen once and twice
DOCS_EACH, REJECT, WINDOW, WINDOWS = 300, 0.995, 200, 20
BITS = 16  #: a symbol's; 0 is the boundary
CACHE = 20  #: the table of a worker has 2**CACHE places


def _letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for other code points."""
    found = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            found[c] = ord(low) if len(low) == 1 else c
    return found


_cache: dict = {}


def letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    return _cache["letters"]


def symbol_table() -> np.ndarray:
    if "symbols" not in _cache:
        low = letters()
        _cache["symbols"] = np.where(low < 1 << BITS, low, 0xD800 + low % 2048).astype(np.uint16)
    return _cache["symbols"]


def symbols(text: str) -> np.ndarray:
    """ORDER - 1 boundaries, then the text's symbols with one boundary for each run of other characters, then a boundary."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol_table()[points]
    keep = np.ones(len(s), bool)
    keep[0:1] = s[0:1] > 0
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s = s[keep]
    end = [] if len(s) and s[-1] == 0 else [0]
    return np.concatenate([np.zeros(ORDER - 1, np.uint16), s, np.array(end, np.uint16)])


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """The codes of all n-grams of s; the code without its last symbol is the context's, without its first the shorter n-gram's."""
    h = np.zeros(max(0, len(s) - n + 1), np.uint64)
    for i in range(n):
        h = (h << np.uint64(BITS)) | s[i : len(h) + i]
    return h


def hashed(codes: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    h = codes.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _by_hash(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = hashed(codes)
    order = np.argsort(h)
    return h[order], values[order]


class Model:
    """Sorted hash arrays of one language: for each order, n-grams with discounted probabilities, and contexts with back-off weights."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, discount: float | None = None):
        """codes: distinct ORDER-grams, sorted."""
        self.levels = []
        c = counts.astype(float)
        for n in range(ORDER, 0, -1):
            once, twice = int((c == 1).sum()), int((c == 2).sum())
            d = discount or (once / (once + 2 * twice) if once and twice else DISCOUNT)
            context = codes >> np.uint64(BITS)  # sorted too
            at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.empty(0, np.int64)
            total, kinds = np.add.reduceat(c, at) if len(at) else c, np.diff(np.append(at, len(codes)))
            share = np.maximum(c - d, 0) / np.repeat(total, kinds) if len(at) else c
            self.levels.append((*_by_hash(codes, share), *_by_hash(context[at], d * kinds / total if len(at) else c)))
            # lower orders count the contexts that a shorter n-gram follows
            if n > 1:
                codes, c = np.unique(codes & np.uint64((1 << BITS * (n - 1)) - 1), return_counts=True)
                c = c.astype(float)

    @classmethod
    def of(cls, parts: list[np.ndarray], discount: float | None = None):
        return cls(*np.unique(np.concatenate([grams(s, ORDER) for s in parts] or [np.empty(0, np.uint64)]), return_counts=True), discount)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        wanted = hashed(wanted)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], missing)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Of the last symbol of each ORDER-gram after the others; every distribution sums to 1 over the symbols."""
        p = np.full(len(codes), 1.0 / (1 << BITS))
        for n in range(1, ORDER + 1):
            keys, share, contexts, back = self.levels[ORDER - n]
            short = codes & np.uint64((1 << BITS * n) - 1)
            p = self._find(keys, share, short, 0.0) + self._find(contexts, back, short >> np.uint64(BITS), 1.0) * p
        return p


def calibrate(langs: list[str], models: list[Model], windows: list[tuple[str, np.ndarray]]) -> dict:
    """The fitted models with temperature and rejection limits from held-out windows (language, ORDER-gram codes)."""
    found = {"langs": langs, "models": models, "temperature": 1.0, "limits": [99.0] * len(langs)}
    windows = [(k, g) for k, g in windows if len(g) >= 10]
    if windows:
        y, n = np.array([langs.index(k) for k, _ in windows]), np.array([len(g) for _, g in windows])
        flat, start = np.concatenate([g for _, g in windows]), np.cumsum(n) - n
        x = np.stack([np.add.reduceat(-np.log2(m.probability(flat)), start) for m in models], axis=1)
        best = []
        for t in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0):
            z = -x * np.log(2) * t
            z -= z.max(axis=1, keepdims=True)
            best.append((-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean(), t))
        found["temperature"] = min(best)[1]
        rate = x[np.arange(len(y)), y] / n
        found["limits"] = [float(np.quantile(rate[(y == k) & (n > 20)], REJECT)) if ((y == k) & (n > 20)).any() else 99.0 for k in range(len(langs))]
    return found


class Scorer:
    """Cross-entropies of texts; n-grams that were met lately are not looked up in the models again."""

    def __init__(self, fitted: dict):
        self.fitted = fitted
        self.tag = np.full(1 << CACHE, (1 << 64) - 1, np.uint64)  # no letter is U+FFFF
        self.bits = np.zeros((1 << CACHE, len(fitted["langs"])), np.float32)

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        place = (hashed(codes) >> np.uint64(64 - CACHE)).astype(np.int64)
        new = np.flatnonzero(self.tag[place] != codes)
        out = self.bits[place]
        if len(new):
            wanted, at = np.unique(codes[new], return_inverse=True)
            found = np.stack([-np.log2(m.probability(wanted)) for m in self.fitted["models"]], axis=1).astype(np.float32)
            out[new] = found[at]
            where = (hashed(wanted) >> np.uint64(64 - CACHE)).astype(np.int64)
            where, last = np.unique(where, return_index=True)
            self.tag[where], self.bits[where] = wanted[last], found[last]
        return out

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits by text and language, scored symbols and letters by text."""
        parts = [symbols(t) for t in texts]
        sizes = np.array([max(0, len(s) - ORDER + 1) for s in parts])
        n_letters = np.array([int(np.count_nonzero(s)) for s in parts])
        out = np.zeros((len(texts), len(self.fitted["langs"])))
        at = 0
        while at < len(parts):  # about a million symbols at a time, or one text
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 20, "right")))
            bits = self._bits(np.concatenate([grams(s, ORDER) for s in parts[at:end]]))
            some = at + np.flatnonzero(sizes[at:end])
            if len(some):
                out[some] = np.add.reduceat(bits, (np.cumsum(sizes[some]) - sizes[some]), axis=0, dtype=np.float64)
            at = end
        return out, sizes, n_letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool, float | None]]:
        """(lang_pred, score, accepted, cross-entropy a symbol) of each text."""
        f = self.fitted
        if not f["langs"]:
            return [("und", 0.0, False, None)] * len(texts)
        bits, sizes, n_letters = self.losses(texts)
        out = []
        for x, n, k in zip(bits, sizes, n_letters):
            if not k:
                out.append(("und", 0.0, False, None))
                continue
            i = int(np.argmin(x))
            z = np.exp(-(x - x[i]) * np.log(2) * f["temperature"])
            out.append((f["langs"][i], float(1 / z.sum()), bool(x[i] / n <= f["limits"][i]), float(x[i] / n)))
        return out


def _fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = DOCS_EACH) -> DataFrame:
    """lang, n, text: at most `most` training texts a language, those of the least md5 of their id. Texts are filtered where they are read."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = docs.filter((_fold(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return rows.select(F.col(lang_col).cast("string").alias("lang"), F.lit(0).alias("n"), F.col(text_col).alias("text")).limit(0)
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.5 * most / n) * (1 << 32)))])
    picked = rows.select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).alias("text")).filter(F.col("key") <= limits[F.col("lang")])
    first = W.partitionBy("lang").orderBy("key", "text")
    return picked.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).select("lang", "n", "text")


def _count(batches):
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            code, n = np.unique(grams(symbols(text), ORDER), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "code", "n"])


def _windows(batches):
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            g = grams(symbols(text), ORDER).view(np.int64)
            cut = [g[i : i + size].tolist() for size in (20, WINDOW) for i in np.unique(np.linspace(0, max(0, len(g) - size), WINDOWS).astype(int)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut), pa.string()), pa.array(cut, pa.list_(pa.int64()))], names=["lang", "codes"])


def learn(rows: DataFrame) -> dict:
    """Models, temperature and rejection limits of the rows of sample(); every tenth text is held back."""
    small_batches(rows.sparkSession)
    with Tables(rows.sparkSession) as held:
        rows = held.keep(rows, "language-sample")
        counts = rows.filter("n % 10 <> 0").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
        cut = rows.filter("n % 10 = 0").mapInArrow(_windows, "lang string, codes array<long>").orderBy("lang", "codes").toArrow()
    lang, code, n = (counts.column(c).to_numpy() for c in ("lang", "code", "n"))
    langs, models = sorted(set(lang.tolist())), []
    for name in langs:
        own = code[lang == name].view(np.uint64)
        order = np.argsort(own)
        models.append(Model(own[order], n[lang == name][order]))
    return calibrate(langs, models, [(k, np.array(g, np.int64).view(np.uint64)) for k, g in zip(cut.column("lang").to_pylist(), cut.column("codes").to_pylist())])


def identify(docs: DataFrame, fitted: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, cross_entropy of every whole text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    types = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]

    def run(batches):
        scorer = Scorer(fitted)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = scorer.predict(batch.column("text").to_pylist())
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), *cols], names=["doc_id", "held_out", "lang_pred", "score", "accepted", "cross_entropy"])

    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, cross_entropy double")


def op6_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(sample(docs)))
