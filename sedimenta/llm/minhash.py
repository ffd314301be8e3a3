"""Near-duplicate classes by a MinHash containment ensemble.

A text A is linked to a text B of no fewer shingles where |A & B| >= THRESHOLD * |A| (SHINGLE words a shingle). Two texts
that are linked and hold for |B| too are *near copies*; a link that holds for A only makes B a *container* of A.

Classes: near copies share a class (components). A class whose texts have containers outside it joins the class of one
of them, the largest text (then the least node), since its words are there. It never joins two: otherwise a
short text that two different long ones quote would make one class of these. The document that stays is the least
doc_id of the class that joined no other, so that a container stays rather than what it contains.

1. *Ensemble.* Sets are partitioned by size, a factor of four each. For a pair of partitions, containment becomes the least
   Jaccard similarity that a linked pair of such sizes can have, and rows and bands are tuned for it (ensemble()).
   For sizes within THRESHOLD of each other that is a banding of several rows of HASHES minima. For larger containers
   the tuned bands have one row, and hundreds of them: a key is then one shingle, and a passage that many documents share
   would pair all of these. Step 4 finds such pairs by the same minima without such groups.
2. *Candidates of like size.* A bucket of band keys is sorted at a time; buckets are as many as the keys' bytes need. Groups
   of up to SMALL members give all their pairs, larger ones a star from the least member.
3. *Exact check* of these, and components: the classes of near copies so far.
4. *Containers.* The k least shingle hashes of a set are its minima: all of up to EXACT, PROBES of a larger set. A text that
   contains 0.8 of the set has at least `least` of them (for sure, or with a miss of at most MISS), so at least one of
   the k - least + 1 rarest. Texts send only shingles that are somebody's minimum (a bit array that grows with their number tells). Rarity
   is counted in classes. Where a shingle is in more than MANY classes, those with the same set of shingles as frequent (that anyone consults)
   are represented by their largest text, and a class by two texts a shingle. These go first, as they are linear in the input.
5. *Exact check* of these, near copies again, and the best container so far of each class.
6. *The rest.* All other texts that have such a shingle are tried too, whatever their number, but those of a's own class
   and those that are neither of like size nor a better container than the one found, since they could change nothing. All
   sizes take part, so links of like size that a star missed are found here as well. Where classes grow by what is
   found, this is done again for these classes.

Bit arrays of up to 128 MB are broadcast; else nothing but counts reaches the driver.

Nulls and edge cases: a null text counts as empty; texts without words are linked to equal texts only;
texts of one to four words have themselves as their one shingle; repeated rows and equal texts share a class, whatever
their doc_ids; null doc_ids come last, so class_id is null only where all that may stay are; ties of size between
containers go to the least node; extra columns are ignored by near_duplicates() and kept by drop_near_duplicates().
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Tables, fresh, release, small_batches, table, text_or_empty

SHINGLE, THRESHOLD, HASHES, MISS = 5, 0.8, 128, 2e-3
SMALL, HOT_LOCAL, FLUSH = 8, 64, 1 << 21
PROBES, EXACT, MANY = 24, 64, 16
PLACES, MOST_BITS = 16, 30  #: places a number in a bit array; 2**MOST_BITS are 128 MB
BUCKET = 8 << 20  #: bytes of keys that one task sorts
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


# --- ensemble ----------------------------------------------------------------------------------------


def partition_of(n: int) -> int:
    """0 for 1..4, 1 for 5..16, and so on."""
    return max(0, math.ceil(math.log(n, 4) - 1e-9) - 1)


def sizes_of(p: int) -> tuple[int, int]:
    return (4**p + 1 if p else 1), 4 ** (p + 1)


@lru_cache(maxsize=None)
def least_jaccard(a: tuple[int, int], b: tuple[int, int], t: float = THRESHOLD) -> float:
    """The least Jaccard similarity of a set with its size in a, t of which is contained in a set with its size in b."""
    worst = 1.0
    for n in range(a[0], min(a[1], a[0] + 200) + 1):  # the ratio of the sizes is the greatest at the least n; rounding fades
        shared = math.ceil(t * n - 1e-9)
        worst = min(worst, shared / (max(n, b[1]) + n - shared))
    return worst


def like_jaccard(a: tuple[int, int], t: float = THRESHOLD) -> float:
    """The same of near copies, of which the larger has its size in a."""
    return min(s / (2 * n - s) for n in range(a[0], min(a[1], a[0] + 200) + 1) for s in [math.ceil(t * n - 1e-9)])


@lru_cache(maxsize=None)
def missed(s: float, rows: int, bands: int) -> float:
    """The chance that no band agrees for a pair of similarity s, where all bands choose from the same HASHES minima."""
    lg = math.lgamma
    out = 0.0
    for k in range(HASHES + 1):
        p = math.exp(lg(HASHES + 1) - lg(k + 1) - lg(HASHES - k + 1) + k * math.log(s) + (HASHES - k) * math.log(1 - s)) if 0 < s < 1 else float(k == HASHES)
        hit = math.comb(k, rows) / math.comb(HASHES, rows)
        out += p * (1 - hit) ** bands
    return out


@lru_cache(maxsize=None)
def tune(s: float, miss: float = MISS, most: int = 110) -> tuple[int, int]:
    """The most selective rows, and their least number of bands, that miss similarity s by at most miss; one row where none do."""
    if s >= 1:
        return 16, 1
    for r in range(12, 0, -1):
        low, high = 1, most if r > 1 else 1 << 20
        if r > 1 and missed(s, r, most) > miss:
            continue
        if r == 1:  # more bands than minima: each has a minimum of its own
            return 1, math.ceil(math.log(miss) / math.log(1 - s))
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if missed(s, r, mid) <= miss else (mid + 1, high)
        return r, low


def ensemble(most: int = 8) -> dict[tuple[int, int], tuple[float, int, int]]:
    """For partitions (of the contained set, of the container): least Jaccard similarity, rows, bands. (p, p) is that of near copies."""
    out = {}
    for p in range(most):
        for q in range(p, most):
            s = like_jaccard(sizes_of(p)) if p == q else least_jaccard(sizes_of(p), sizes_of(q))
            out[p, q] = (s, *tune(s))
    return out


@lru_cache(maxsize=None)
def probe_plan(n: int, t: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(k, least): of a set of n shingles, k minima are looked for and a container has at least `least` of them."""
    if n <= EXACT:
        return n, max(1, math.ceil(t * n - 1e-9))
    below, least = 0.0, 0
    for k in range(PROBES + 1):
        below += math.comb(PROBES, k) * t**k * (1 - t) ** (PROBES - k)
        if below > miss:
            break
        least = k + 1
    return PROBES, max(1, least)


def n_probes(n: np.ndarray) -> np.ndarray:
    return np.where(n <= EXACT, n, PROBES)


_bands: dict[int, np.ndarray] = {}


def bands_of(p: int) -> np.ndarray:
    """Choices of minima, a row for each band of partition p."""
    if p not in _bands:
        r, b = tune(like_jaccard(sizes_of(p)))
        g = np.random.Generator(np.random.PCG64(1000 + p))
        _bands[p] = np.stack([g.choice(HASHES, r, replace=False) for _ in range(b)])
    return _bands[p]


# --- sets --------------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty where it has no word."""
    known: dict[bytes, int] = {}
    numbers, sizes = [], []
    for t in texts:
        words = t.split()
        numbers += [known.setdefault(w, len(known)) for w in words]
        sizes.append(len(words))
    codes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    flat = codes[np.array(numbers, np.int64)] if numbers else np.empty(0, np.uint64)
    h = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        h = (h + flat[i : len(h) + i]) * _MIX
        h ^= h >> np.uint64(32)
    h = _mix(h)
    out, at = [], 0
    for n in sizes:
        if n >= SHINGLE:
            out.append(np.unique(h[at : at + n - SHINGLE + 1]))
        elif n:
            v = np.uint64(n)
            for c in flat[at : at + n]:
                v = np.uint64(int(v) * int(_MIX) % (1 << 64)) ^ c
                v = _mix(np.array([v]))[0]
            out.append(np.array([v], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set, none of which is empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((HASHES, len(sets)), np.uint32)
    for lo in range(0, len(sets), 512):
        hi = min(lo + 512, len(sets))
        end = starts[hi] if hi < len(sets) else len(x)
        part, at = x[starts[lo] : end], starts[lo:hi] - starts[lo]
        for i in range(HASHES):
            v = part * _A[i] + _B[i]
            v ^= v >> np.uint32(15)
            out[i, lo:hi] = np.minimum.reduceat(v, at)
    return out.T.copy()


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, band key) for every band of the partitions in which a near copy of the set may be the larger one."""
    sizes = np.array([len(s) for s in sets])
    m = minima(sets)
    home = np.array([partition_of(n) for n in sizes])
    into: dict[int, list[int]] = {}
    for i, (p, n) in enumerate(zip(home.tolist(), sizes.tolist())):
        into.setdefault(p, []).append(i)
        if n >= THRESHOLD * (4 ** (p + 1) + 1):
            into.setdefault(p + 1, []).append(i)
    index, keys = [], []
    for p, members in into.items():
        rows = np.array(members)
        for k, choice in enumerate(bands_of(p)):
            h = np.full(len(rows), (p << 16) + k, np.uint64)
            for c in choice:
                h = _mix((h + m[rows, c]) * _MIX)
            index.append(rows)
            keys.append(h)
    return np.concatenate(index), np.concatenate(keys)


def _distinct(batches, flush: int):
    """(nodes, sets) of each batch's texts that have words, each text once; then None whenever some flush bytes of text have gone by."""
    seen: set[int] = set()
    size = 0
    for batch in batches:
        texts, fresh_at = batch.column("text").cast(pa.binary()), []
        for i, node in enumerate(batch.column("node").to_pylist()):
            if node not in seen:
                seen.add(node)
                fresh_at.append(i)
        found = shingle_sets([texts[i].as_py() for i in fresh_at])
        kept = [i for i, s in enumerate(found) if len(s)]
        if kept:
            yield batch.column("node").to_numpy()[fresh_at][kept], [found[i] for i in kept]
        size += batch.nbytes
        if size > flush:
            yield None
            seen, size = set(), 0
    yield None
    release()


# --- candidates of like size -------------------------------------------------------------------------

_SENT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_SENT_SQL = "bucket long, kind int, keys binary, nodes binary, sizes binary"


def _batch(rows, schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _by_bucket(bucket: np.ndarray, at: np.ndarray):
    """(bucket, positions) for the buckets of the positions at."""
    at = at[np.argsort(bucket[at], kind="stable")]
    b, start = np.unique(bucket[at], return_index=True)
    return zip(b.tolist(), np.split(at, start[1:]) if len(at) else [])


def _once(keys: np.ndarray, nodes: np.ndarray):
    """The order of keys and nodes without repeated pairs."""
    order = np.lexsort((nodes, keys))
    k, n = keys[order], nodes[order]
    return order[~np.append(np.zeros(min(1, len(k)), bool), (k[1:] == k[:-1]) & (n[1:] == n[:-1]))]


def _send(buckets: int):
    """kind 0: band keys and nodes, packed by bucket; keys that are hot within a task send a star (kind 1) and its middle. kind 3: sets' minima and sizes."""

    def pack(keys: np.ndarray, nodes: np.ndarray):
        once = _once(keys, nodes)
        keys, nodes = keys[once], nodes[once]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(first, len(keys)))
        hot = np.repeat(n > HOT_LOCAL, n)
        lead = np.repeat(nodes[first], n)
        is_lead = np.zeros(len(keys), bool)
        is_lead[first] = True
        bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        rows = [(v, 0, keys[i].tobytes(), nodes[i].tobytes(), b"") for v, i in _by_bucket(bucket, np.flatnonzero(~hot | is_lead))]
        star = np.flatnonzero(hot & ~is_lead)
        if len(star):
            pairs = np.unique(np.stack([lead[star], nodes[star]]), axis=1)
            rows.append((int(lead[star[0]] % np.int64(buckets)), 1, pairs[0].tobytes(), pairs[1].tobytes(), b""))
        return _batch(rows, _SENT)

    def run(batches):
        keys, nodes = [], []
        for found in _distinct(batches, 8 << 20):
            if found is None:
                if keys:
                    yield pack(np.concatenate(keys), np.concatenate(nodes))
                keys, nodes = [], []
                continue
            node, sets = found
            sizes = np.array([len(s) for s in sets], np.int32)
            least = [s[:k] for s, k in zip(sets, n_probes(sizes).tolist())]
            yield _batch([(int(node[0] % np.int64(buckets)), 3, np.concatenate(least).tobytes(), node.tobytes(), sizes.tobytes())], _SENT)
            i, k = band_keys(sets)
            keys.append(k)
            nodes.append(node[i])

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("probes", pa.binary())])


def _group(t: pa.Table) -> pa.Table:
    """kind 1: a candidate pair (a < b); kind 3: node a has b shingles, and probes are the least of their hashes."""
    kinds = t.column("kind").to_pylist()
    blobs = list(zip(kinds, t.column("keys").to_pylist(), t.column("nodes").to_pylist(), t.column("sizes").to_pylist()))
    take = lambda kind, kt: (np.concatenate([np.empty(0, kt), *(np.frombuffer(k, kt) for x, k, _, _ in blobs if x == kind)]), np.concatenate([np.empty(0, np.int64), *(np.frombuffer(n, np.int64) for x, _, n, _ in blobs if x == kind)]))
    a1, b1 = take(1, np.int64)
    keys, nodes = take(0, np.uint64)
    once = _once(keys, nodes)
    keys, nodes = keys[once], nodes[once]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(keys)))
    size, lead, lead_at = np.repeat(n, n), np.repeat(nodes[first], n), np.repeat(first, n)
    a, b = [a1], [b1]
    for d in range(1, SMALL):  # all pairs of small groups
        i = np.flatnonzero((size <= SMALL) & (size > d))
        i = i[i + d < len(keys)]
        i = i[keys[i] == keys[i + d]]
        a.append(nodes[i])
        b.append(nodes[i + d])
    star = np.flatnonzero((size > SMALL) & (np.arange(len(keys)) > lead_at))
    a.append(lead[star])
    b.append(nodes[star])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    out = [pa.table([pa.array(np.full(pairs.shape[1], 1, np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.binary())], schema=_FOUND)]
    for kind, probes, node, sizes in blobs:
        if kind == 3:
            node, sizes = np.frombuffer(node, np.int64), np.frombuffer(sizes, np.int32)
            ends = np.append(0, np.cumsum(n_probes(sizes))).astype(np.int32) * 8
            parts = pa.Array.from_buffers(pa.binary(), len(node), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(probes)])
            out.append(pa.table([pa.array(np.full(len(node), 3, np.int32)), pa.array(node), pa.array(sizes.astype(np.int64)), parts], schema=_FOUND))
    release()
    return pa.concat_tables(out)


# --- containers --------------------------------------------------------------------------------------


def log_bits(n: int) -> int:
    """Bits of a place in a bit array of n numbers: PLACES of them a number, so that some 1.4 % of others pass. Only past 67 million numbers more do."""
    return min(MOST_BITS, max(16, math.ceil(math.log2(max(1, n) * PLACES))))


def _places(v, width: int):
    """Two places below 2**width for a number, as Spark columns or as arrays of unsigned numbers."""
    low = (1 << width) - 1
    if isinstance(v, np.ndarray):
        return v & v.dtype.type(low), v >> v.dtype.type(64 - width - 20) & v.dtype.type(low)
    return v.bitwiseAND(low), F.shiftrightunsigned(v, 64 - width - 20).bitwiseAND(low)


def bits_of(numbers: DataFrame, n: int) -> np.ndarray:
    """A bit array with two bits set for each number, sized for n of them. numbers: (v long)."""
    width = log_bits(n)
    at = F.explode(F.array(*_places(F.col("v"), width))).alias("at")
    rows = numbers.select(at).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).toArrow()
    out = np.zeros((1 << width) >> 3, np.uint8).reshape(-1, 4096)
    for k, bits in zip(rows.column("k").to_pylist(), rows.column("bits")):
        out[k - 1] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def has_bits(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    at = np.arange(len(v))
    for turn in range(2):  # the second place only of those that pass the first
        place = _places(v[at].view(np.uint64), len(bits).bit_length() + 2)[turn]
        at = at[bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0]
    seen = np.zeros(len(v), bool)
    seen[at] = True
    return seen


def _probe_hashes(batches):
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("probes").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(flat))], names=["v"])


def _postings(bits, buckets: int):
    """kind 0: shingles that are somebody's minimum, with node and size (negative: a minimum of the node itself), packed by bucket.
    Shingles that are hot within a task go apart (kind 2), spread over buckets, with a mark (node 0, size 0) in their own."""

    def pack(h, nodes, sizes, turn: int):
        once = _once(h, nodes)
        h, nodes, sizes = h[once], nodes[once], sizes[once]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h)))
        hot = np.repeat(n > HOT_LOCAL, n)
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        row = lambda v, kind, i: (v, kind, h[i].tobytes(), nodes[i].tobytes(), sizes[i].tobytes())
        rows = [row(v, 0, i) for v, i in _by_bucket(bucket, np.flatnonzero(~hot))]
        mark = first[n > HOT_LOCAL]
        rows += [(v, 0, h[i].tobytes(), bytes(8 * len(i)), bytes(4 * len(i))) for v, i in _by_bucket(bucket, mark)]
        rows += [row((turn + j) % buckets, 2, i) for j, i in enumerate(np.array_split(np.flatnonzero(hot), max(1, int(hot.sum()) >> 16))) if len(i)]
        return _batch(rows, _SENT)

    def run(batches):
        from pyspark import TaskContext

        have, parts, turn = bits.value, [], TaskContext.get().partitionId()
        for found in _distinct(batches, 32 << 20):
            if found is not None:
                node, sets = found
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                own = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n_probes(n), n)
                keep = own | has_bits(have, flat)
                parts.append((flat[keep], np.repeat(node, n)[keep], np.repeat(n, n)[keep].astype(np.int32) * np.where(own[keep], -1, 1).astype(np.int32)))
            if parts and (found is None or sum(len(p[0]) for p in parts) > FLUSH):
                yield pack(*map(np.concatenate, zip(*parts)), turn)
                parts, turn = [], turn + 1

    return run


def _shared(t: pa.Table) -> pa.Table:
    """h, node, n, probe: postings of the bucket's shingles that are in two texts or more and a minimum of one; those that went apart."""
    out = []
    for kinds in (0, 2):
        parts = [(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(s, np.int32)) for x, k, n, s in zip(*(t.column(c).to_pylist() for c in ("kind", "keys", "nodes", "sizes"))) if x == kinds]
        if not parts:
            continue
        h, node, size = map(np.concatenate, zip(*parts))
        if kinds == 0:
            once = _once(h, node)
            h, node, size = h[once], node[once], size[once]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(first, len(h)))
            real = np.add.reduceat((size != 0).astype(np.int64), first)
            marked, probed = real < n, np.maximum.reduceat((size < 0).astype(np.int64), first) > 0
            keep = np.repeat(marked | (probed & (n > 1)), n) & (size != 0)
            h, node, size = h[keep], node[keep], size[keep]
        out.append(pa.table({"h": h.view(np.int64), "node": node, "n": np.abs(size).astype(np.int64), "probe": size < 0}))
    return pa.concat_tables(out) if out else pa.table({"h": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "probe": pa.array([], pa.bool_())})


def _container_pairs(postings: DataFrame, label: DataFrame, held: Tables):
    """a, b: first candidates, b with at least as many shingles as a, of another class, and with enough of a's minima. A function that gives the others."""
    # copies of a text in several tasks each send what is hot there: a text counts once
    p = postings.join(label, "node", "left").select("h", "node", "n", "probe", F.coalesce("label", "node").alias("cls")).dropDuplicates(["node", "h"])
    p = held.keep(p, "near-shared")
    # two texts a class and shingle, the largest and one that differs from shingle to shingle: a class of thousands of copies counts once
    largest, other = F.max(F.struct(F.col("n").alias("bn"), (-F.col("node")).alias("least"), F.col("node").alias("b"))), F.min(F.struct(F.xxhash64("node", "h").alias("any"), F.col("n").alias("bn"), F.col("node").alias("b")))
    of = held.keep(p.groupBy("h", "cls").agg(largest.alias("w"), other.alias("x")).select("h", "cls", F.col("w.bn").alias("bn"), F.col("w.b").alias("b"), F.col("x.bn").alias("xn"), F.col("x.b").alias("x")), "near-of")
    df = held.keep(of.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-df")
    k = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(PROBES)
    small = F.ceil(F.col("n") * F.lit(THRESHOLD) - 1e-9)
    least = F.when(F.col("n") <= EXACT, F.greatest(F.lit(1), small)).otherwise(F.lit(probe_plan(EXACT + 1)[1]))
    probes = p.filter("probe").join(df, "h").withColumn("found", F.count(F.lit(1)).over(W.partitionBy("node"))).filter(F.col("found") >= least)
    rank = F.row_number().over(W.partitionBy("node").orderBy("df", "h"))
    chosen = probes.withColumn("rank", rank).filter((F.col("rank") <= F.col("found") - least + 1) & (k >= least)).select("h", F.col("node").alias("a"), F.col("n").alias("an"), F.col("cls").alias("acls"), "df")
    chosen = held.keep(chosen, "near-chosen")
    asked = chosen.select("h", "df").distinct()
    few = of.join(asked.filter(F.col("df") <= MANY).select("h"), "h")
    few = few.select("h", "cls", "bn", "b").union(few.filter("x <> b").select("h", "cls", "xn", "x"))
    # a text that consults a shingle has no rarer one to go by, so classes with the same set of equally or more frequent ones (of those that anyone consults) are alike to it
    many = of.join(asked.filter(F.col("df") > MANY).select("h", F.floor(F.log2("df")).alias("level")), "h")
    levels = many.groupBy("cls", "level").agg(F.bit_xor(F.xxhash64("h")).alias("part"))
    upward = W.partitionBy("cls").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    alike = levels.select("cls", "level", F.bit_xor("part").over(upward).alias("alike"))
    many = many.join(alike, ["cls", "level"]).groupBy("h", "alike").agg(F.max(F.struct("bn", (-F.col("b")).alias("least"), "b", "cls")).alias("w")).select("h", F.col("w.cls").alias("cls"), F.col("w.bn").alias("bn"), F.col("w.b").alias("b"))
    tried = held.keep(chosen.join(few.union(many), "h").filter("b <> a and bn >= an and cls <> acls").select("a", "b").distinct(), "near-seen")
    lists = held.keep(p.groupBy("node").agg(F.collect_list("h").alias("there"), F.collect_list(F.when(F.col("probe"), F.col("h"))).alias("looked"), F.first(least).alias("least")), "near-lists")
    of_a = lists.join(chosen.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), "looked", "least")
    of_b = lists.select(F.col("node").alias("b"), "there")

    def enough(pairs: DataFrame) -> DataFrame:
        return pairs.join(of_a, "a").join(of_b, "b").filter(F.size(F.array_intersect("looked", "there")) >= F.col("least")).select("a", "b")

    def others(done: DataFrame, label: DataFrame, best: DataFrame, threshold: float, grown: DataFrame | None) -> DataFrame:
        """All candidates of the classes in grown (None: of all) but those done that can still matter: of like size, or a better container than the best of a's class. best: (la, most, at)."""
        la, lb = (label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        asks = chosen.select("h", "a", "an", "acls").join(la, "a", "left").withColumn("la", F.coalesce("la", "a"))
        if grown is not None:
            asks = asks.join(grown, "la", "left_semi")
        asks = asks.join(best, "la", "left").join(of.select("h", "cls", F.greatest("bn", "xn").alias("bn")), "h").filter("bn >= an and cls <> acls").drop("bn", "acls")
        better = F.isnull("most") | (F.col("bn") > F.col("most")) | ((F.col("bn") == F.col("most")) & (F.col("b") < F.col("at")))
        pairs = asks.join(p.select("h", "cls", F.col("node").alias("b"), F.col("n").alias("bn")), ["h", "cls"]).filter("b <> a and bn >= an").filter((F.col("an") >= F.col("bn") * threshold - 1e-9) | better)
        pairs = pairs.groupBy("a", "b").agg(F.first("la").alias("la")).join(done, ["a", "b"], "left_anti")
        return enough(held.keep(pairs.join(lb, "b", "left").filter(F.col("la") != F.coalesce("lb", "b")).select("a", "b"), "near-others"))

    return enough(tried), others


# --- exact checks and classes ------------------------------------------------------------------------


def _sets_of(bits, kind):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        have = bits.value
        for batch in batches:
            batch = batch.filter(pa.array(has_bits(have, batch.column("node").to_numpy())))
            if batch.num_rows:
                sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([(s >> np.uint64(64 - 8 * kind().itemsize)).astype(kind).tobytes() for s in sets], pa.binary())], schema=schema)
        release()

    return run


def _contained(kind):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("shared", pa.int64())])

    def run(batches):
        for batch in batches:
            shared = []
            for p, q in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                p, q = np.frombuffer(p, kind), np.frombuffer(q, kind)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                i = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared.append(int((large[i] == small).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(shared, pa.int64())], schema=schema)
        release()

    return run


def _compare(pairs: DataFrame, plain: DataFrame, threshold: float, like: bool, held: Tables, kind) -> DataFrame:
    """a, b, na, nb, shared of the linked ones of pairs (a, b). Only texts whose node's bit is set are made sets. kind: of the leading bits by which
    shingles are compared; with fewer than 64, shared is no less than it is, so that links and some others are left."""
    nodes = pairs.select(F.col("a").alias("v")).union(pairs.select("b"))
    bits = held.send(bits_of(nodes, 2 * pairs.count()))
    sets = plain.mapInArrow(_sets_of(bits, kind), "node long, n long, shingles binary").join(nodes.distinct().withColumnRenamed("v", "node"), "node", "left_semi").dropDuplicates(["node"])
    sa, sb = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    joined = pairs.join(sa, "a").join(sb, "b")
    if like:
        joined = joined.filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    found = joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_contained(kind), "a long, b long, na long, nb long, shared long")
    return found.filter(F.col("shared") >= threshold * (F.greatest("na", "nb") if like else F.least("na", "nb")) - 1e-9)


def _check(pairs: DataFrame, plain: DataFrame, threshold: float, like: bool, held: Tables) -> DataFrame:
    """a, b, na, nb, shared of the linked ones of pairs (a, b); like: only near copies are wanted."""
    if not like:  # few of these are links: most go by 16 bits of each shingle, which never lose one
        pairs = held.keep(_compare(pairs, plain, threshold, like, held, np.uint16).select("a", "b"), "near-likely")
    return _compare(pairs, plain, threshold, like, held, np.uint64)


def components(links: DataFrame, held: Tables, name: str = "near-labels") -> DataFrame:
    """node, label: the least node of each linked node's component. Rounds of least-neighbour and label-of-label, each a written table."""
    both = held.keep(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), f"{name}-edges")
    label = held.keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), name)
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = held.keep(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), name)
        changed = new.filter("label <> old").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def _links(plain: DataFrame, threshold: float, held: Tables) -> tuple[DataFrame, DataFrame]:
    """node and label of near copies; a, b, na, nb, shared of contained texts and containers that the search gave."""
    n = plain.count()
    buckets = max(8, math.ceil(n * 16 * (len(bands_of(3)) + PROBES) / BUCKET))
    sent = plain.mapInArrow(_send(buckets), _SENT_SQL)
    found = held.keep(sent.groupBy("bucket").applyInArrow(_group, "kind int, a long, b long, probes binary"), "near-found")
    pairs = held.keep(found.filter("kind = 1").select("a", "b").distinct(), "near-pairs")
    like = held.keep(_check(pairs, plain, threshold, True, held), "near-links")
    held.forget()
    label = components(like, held)

    words, probes = (int(x or 0) for x in found.filter("kind = 3").agg(F.sum("b"), F.sum(F.octet_length("probes")) / 8).first())
    bits = bits_of(found.filter("kind = 3").select("probes").mapInArrow(_probe_hashes, "v long"), probes)
    filled, bits = float(np.bitwise_count(bits).sum(dtype=np.int64)) / (8 * len(bits)), held.send(bits)
    buckets = max(8, math.ceil((2 * PROBES * n + filled**2 * words) * 20 / BUCKET))
    postings = plain.mapInArrow(_postings(bits, buckets), _SENT_SQL).groupBy("bucket").applyInArrow(_shared, "h long, node long, n long, probe boolean")
    first, others = _container_pairs(postings, label, held)
    done = tried = held.keep(first, "near-tried")
    held.forget()
    links, near, grown = None, like.select("a", "b"), None
    both = F.col("shared") >= threshold * F.greatest("na", "nb") - 1e-9
    while True:
        new = held.keep(_check(tried, plain, threshold, False, held), "near-contained")
        held.forget()
        more = new.filter(both).limit(1).count()
        if more:
            near = near.union(new.filter(both).select("a", "b"))
            old, label = label.withColumnRenamed("label", "old"), components(near, held)
            if links is not None:  # other classes have no candidates but those of the round before
                grown = label.join(old, "node", "left").filter(F.coalesce("old", "node") != F.col("label")).select(F.col("label").alias("la")).distinct()
        elif links is not None:  # the classes stay as they are, so all that was passed over is no better than what was found
            return label, links.union(new).filter(~both)
        links = new if links is None else links.union(new)
        best = held.keep(_best(links.filter(~both), label).select("la", F.col("w.nb").alias("most"), F.col("w.b").alias("at")), "near-best")
        tried = held.keep(others(done, label, best, threshold, grown), "near-tried")
        if not tried.limit(1).count():
            return label, links.filter(~both)
        done = done.union(tried)


def _best(contained: DataFrame, label: DataFrame) -> DataFrame:
    """la, w: each class's one container outside it: the largest text, then the least node."""
    la, lb = (label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    up = contained.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), "nb", "b").filter("la <> lb")
    return up.groupBy("la").agg(F.max(F.struct("nb", (-F.col("b")).alias("least"), "lb", "b")).alias("w"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the doc_id that stays), class_size (rows), node (its text's 64-bit hash), label (its class's least node), may_stay."""
    small_batches(docs.sparkSession, 2)
    with Tables(docs.sparkSession) as held:
        base = _nodes(docs, id_col, text_col)
        label, contained = _links(base.select("node", "text"), threshold, held)
        up = held.keep(_best(contained, label).select("la", F.col("w.lb").alias("lb")), "near-up")
        top = components(up.select(F.col("la").alias("a"), F.col("lb").alias("b")), held).select(F.col("node").alias("label"), F.col("label").alias("top"))
        rows = held.keep(base.select("doc_id", "node"), "near-rows").join(label, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("near"))
        rows = rows.join(top.withColumnRenamed("label", "near"), "near", "left").join(up.select(F.col("la").alias("near"), F.lit(True).alias("inside")), "near", "left")
        rows = held.keep(rows.select("doc_id", "node", F.coalesce("top", "near").alias("label"), F.isnull("inside").alias("free")), "near-rows")
        classes = rows.groupBy("label").agg(F.max("free").alias("some"), F.min(F.when(F.col("free"), F.col("doc_id"))).alias("free_id"), F.min("doc_id").alias("any_id"), F.count(F.lit(1)).alias("class_size"))
        # where classes contain one another in a ring, all may stay
        classes = classes.select("label", "class_size", "some", F.when(F.col("some"), F.col("free_id")).otherwise(F.col("any_id")).alias("class_id"))
        out = rows.join(classes, "label").select("doc_id", "class_id", "class_size", "node", "label", (F.col("free") | ~F.col("some")).alias("may_stay"))
        return held.result(out, "near-classes")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows, one a class: that of the class's doc_id (null last), by text where doc_ids are equal."""
    found = near_duplicates(docs, threshold, id_col, text_col)
    node, ids, kept = fresh(docs, "near_node", "near_id", "near_kept")
    # the document that stays of each class; classes without doc_ids are told apart by their label
    one = found.filter(F.col("may_stay") & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "class_id").agg(F.min("node").alias(kept))
    with Tables(docs.sparkSession) as held:
        one = held.result(one.select(F.col("class_id").alias(ids), kept), "near-kept")
    out = docs.withColumn(node, F.xxhash64(text_or_empty(text_col)))
    out = out.join(one.hint("shuffle_hash"), (F.col(node) == F.col(kept)) & F.col(id_col).cast("long").eqNullSafe(F.col(ids)), "left_semi")
    # rows that repeat a kept doc_id and its text are the only ones left to drop
    again = found.join(one, (F.col("node") == F.col(kept)) & F.col("doc_id").eqNullSafe(F.col(ids)), "left_semi").groupBy("doc_id", "node").count().filter("count > 1")
    if again.limit(1).count():
        out = out.dropDuplicates([id_col, node])
    return out.drop(node)


def op9_minhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
