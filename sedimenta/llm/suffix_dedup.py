"""Exact removal of repeated byte strings by a difference-cover, bucket-at-a-time suffix sort.

A string of LENGTH bytes that also starts earlier (smaller doc_id, or the same document and a smaller
offset) marks the bytes it covers. Sorting every suffix of a corpus would shuffle LENGTH times the
input, so the suffixes are partitioned in a way that equal strings always meet:

1. *Anchors.* Each window of LENGTH bytes elects the leftmost smallest hash among its GRAM-byte grams.
   Equal windows elect the same gram at the same offset, and neighbours mostly share it: about one
   anchor in 38 bytes. Every block of documents sends the set of its anchor hashes, once each.
2. *Ties.* A bucket of hashes is sorted at a time; blocks learn which of their anchors occur twice or
   more in the corpus. All other windows are unique and need no work.
3. *Suffix buckets.* Only text around tied anchors travels, to the bucket of its anchor. There the
   suffixes are sorted one sub-bucket (anchor range) at a time: first by their leading COVER bytes,
   then by precomputed ranks of a difference-cover sample (period 13, residues 0 1 3 9), which decide
   ties of up to 104 bytes in one comparison. Each segment is laid out with its anchor on a multiple of
   the period, so suffixes that can be equal share a residue and thus a shift to the next sample.
   Neighbours with LENGTH equal bytes form a class; its first member is sent back to its block.
4. *Removal.* In each document, all tied windows but the first ones mark their bytes.

No step sees an unbounded group. A block sends each anchor once, whatever its copies; anchors over HOT
occurrences are not grouped but split into their windows, which are spread by a 128-bit digest, again once
for each block. Hashes only route: equality is decided on bytes (on the 128-bit digest for hot anchors).

Nulls and edge cases: a null text counts as empty; texts under LENGTH bytes come back whole; null
doc_ids count as larger than all others; rows with equal doc_ids are ordered by block and text; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, table, text_or_empty, total_bytes

LENGTH, GRAM, PIECE = 100, 24, 1 << 20
#: Difference cover: any two residues modulo PERIOD have a common shift into COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
HOT = 65_536
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
NONE = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram of buf, from prefix sums: no loop over bytes."""
    up, down = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(buf) + 1 - gram]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(document index, first and last window start, anchor offset, anchor hash) of each run of windows with one anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        buf = np.frombuffer(b"".join(x for *_, x in part), np.uint8)
        sizes = np.array([len(x) for *_, x in part], np.int64)
        ends = np.cumsum(sizes)
        h = gram_hashes(buf, gram)
        n = len(buf) - length + 1
        low = (h & ~np.uint64(PIECE * 2 - 1)) | np.arange(len(h), dtype=np.uint64)
        width, want = 1, length - gram + 1
        while width * 2 <= want:  # minimum over windows of doubling width
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
        at = (low[:n] & np.uint64(PIECE * 2 - 1)).astype(np.int64)
        which = np.repeat(np.arange(len(part)), sizes)[:n]
        valid = np.arange(n) + length <= ends[which]
        starts = np.flatnonzero(valid)
        at, which = at[starts], which[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (which[1:] != which[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        w = which[first]
        shift = (ends - sizes)[w] - np.array([o for _, o, _ in part], np.int64)[w]
        found.append((np.array([d for d, *_ in part], np.int64)[w], starts[first] - shift, starts[last] - shift, at[first] - shift, h[at[first]]))

    for d, text in enumerate(texts):
        for o in range(0, max(1, len(text) - length + 1), PIECE // 2):
            piece = text[o : o + PIECE // 2 + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > PIECE:
                flush()
                part, size = [], 0
            part.append((d, o, piece))
            size += len(piece)
    if part:
        flush()
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _documents(t: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids (NONE for null) and texts of a block, by id and text, so that every pass sees the same ordinals."""
    ids = [NONE if x is None else x for x in t.column("id").to_pylist()]
    texts = t.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _key48(h: np.ndarray) -> np.ndarray:
    return h & ~np.uint64(0xFFFF)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    values, at = np.unique(bucket[order], return_index=True)
    return list(zip(values.tolist(), np.split(order, at[1:])))


def _block_anchors(buckets: int, length: int):
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        *_, h = anchors(_documents(t)[1], length)
        keys, n = np.unique(_key48(h), return_counts=True)
        keys |= np.minimum(n, 0xFFFF).astype(np.uint64)
        parts = _split(_bucket(keys, buckets))
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "keys": pa.array([keys[i].tobytes() for _, i in parts], pa.binary())})

    return run


def _ties(hot: int):
    def run(t: pa.Table) -> pa.Table:
        """Anchor keys that occur twice or more, for each block that has them; the lowest bit is set where hot."""
        blobs = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        blocks = np.repeat(t.column("block").to_numpy(), [len(b) for b in blobs])
        keys = np.concatenate(blobs)
        order = np.argsort(_key48(keys), kind="stable")
        keys, blocks = keys[order], blocks[order]
        first = np.flatnonzero(np.append(True, _key48(keys[1:]) != _key48(keys[:-1])))
        total = np.add.reduceat((keys & np.uint64(0xFFFF)).astype(np.int64), first)
        total = np.repeat(total, np.diff(np.append(first, len(keys))))
        keep = total > 1
        keys = (_key48(keys) | (total > hot).astype(np.uint64))[keep]
        parts = _split(blocks[keep])
        return pa.table({"block": pa.array([b for b, _ in parts], pa.int64()), "tied": pa.array([keys[i].tobytes() for _, i in parts], pa.binary())})

    return run


def _segments(buckets: int, length: int):
    def run(docs: pa.Table, ties: pa.Table) -> pa.Table:
        """What a block sends: text around its tied anchors, digests of hot windows, and its ranges of tied windows."""
        out: dict[str, list] = {"bucket": [], "block": [], "meta": [], "data": []}
        if docs.num_rows and ties.num_rows:
            block = docs.column("block")[0].as_py()
            ids, texts = _documents(docs)
            d, s1, s2, at, h = anchors(texts, length)
            tied = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in ties.column("tied").to_pylist()]))
            keys = _key48(tied)
            k = _key48(h)
            i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            is_tied = keys[i] == k
            is_hot = is_tied & ((tied[i] & np.uint64(1)) == 1)
            idx = np.flatnonzero(is_tied)
            out["bucket"].append(-1 - block)
            out["block"].append(block)
            out["meta"].append(np.stack([d[idx], s1[idx], s2[idx]]).astype(np.int64).tobytes())
            out["data"].append(b"")
            # each different segment once: the earliest stands for the block's others
            seen: dict[tuple, int] = {}
            order = idx[np.argsort(np.array(ids, np.int64)[d[idx]], kind="stable")]
            hot: dict[bytes, tuple[int, int]] = {}
            for x in order.tolist():
                text, lo, hi = texts[d[x]], int(s1[x]), int(s2[x])
                if is_hot[x]:
                    for s in range(lo, hi + 1):
                        hot.setdefault(hashlib.blake2b(text[s : s + length], digest_size=16).digest(), (int(d[x]), s))
                else:
                    seen.setdefault((int(h[x]), int(at[x]) - lo, text[lo : hi + length]), x)
            keep = np.fromiter(seen.values(), np.int64, len(seen))
            segments = [x[2] for x in seen]
            ids_ = np.array(ids, np.int64)
            for b, part in _split(_bucket(h[keep], buckets)):
                x = keep[part]
                meta = np.stack([h[x].view(np.int64), ids_[d[x]], d[x], s1[x], s2[x], at[x]])
                out["bucket"].append(b)
                out["block"].append(block)
                out["meta"].append(meta.astype(np.int64).tobytes())
                out["data"].append(b"".join(segments[j] for j in part.tolist()))
            if hot:
                digests = np.frombuffer(b"".join(hot), np.uint64).reshape(-1, 2)
                where = np.array(list(hot.values()), np.int64)
                for b, part in _split(_bucket(digests[:, 0], buckets)):
                    meta = np.stack([digests[part, 0].view(np.int64), digests[part, 1].view(np.int64), ids_[where[part, 0]], where[part, 0], where[part, 1]])
                    out["bucket"].append(buckets + b)
                    out["block"].append(block)
                    out["meta"].append(meta.tobytes())
                    out["data"].append(b"")
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "meta": pa.array(out["meta"], pa.binary()), "data": pa.array(out["data"], pa.binary())})

    return run


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number; text has seven bytes of padding."""
    return np.lib.stride_tricks.sliding_window_view(text, 8).view(">u8").ravel().astype(np.uint64) if len(text) < 8 else np.ndarray((len(text) - 7,), ">u8", text, 0, (1,)).astype(np.uint64)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs, equal for equal pairs."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), np.int64)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(text: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Rank by 104 bytes of each sample position (pos % PERIOD in COVER), by doubling over the period; 0 elsewhere."""
    pos = np.concatenate([np.arange(r, n, PERIOD) for r in COVER])
    pos.sort()
    ranks = np.zeros(n + 8 * PERIOD + 1, np.int64)
    ranks[pos] = _dense(words[pos], words[pos + 8] >> np.uint64(24))
    step = PERIOD
    while step < 104:  # two ranks fit a word
        pair = (ranks[pos].astype(np.uint64) << np.uint64(32)) | ranks[pos + step].astype(np.uint64)
        ranks[pos] = np.unique(pair, return_inverse=True)[1] + 1
        step *= 2
    return ranks


#: Shift from each residue to the next sample.
SHIFT = np.array([next(s for s in range(PERIOD) if (r + s) % PERIOD in COVER) for r in range(PERIOD)], np.int64)


def firsts(meta: np.ndarray, data: list[bytes], length: int = LENGTH, limit: int = 1 << 20) -> np.ndarray:
    """Rows of (column of meta, first and last start): runs of windows that are the first of their class.

    meta: anchor hash, doc_id, ordinal, first and last start, anchor offset, block of each segment. The
    anchors are taken in runs of about limit bytes, so memory follows the run and not the bucket.
    """
    out = []
    order = np.lexsort((meta[3], meta[2], meta[6], meta[1], meta[0]))
    sizes = np.array([len(x) for x in data], np.int64)[order]
    h = meta[0][order]
    edge = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    before = np.append(0, np.cumsum(sizes + 2 * PERIOD))
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(before[edge], before[edge[i]] + limit, "right")) - 1)
        cols = order[edge[i] : edge[j]]
        i = j
        pieces, starts, total = [], [], 0
        for c in cols.tolist():
            lead = int(meta[5][c] - meta[3][c])
            pad = (-(total + lead)) % PERIOD
            pieces += [bytes(pad), data[c]]
            starts.append(total + pad)
            total += pad + len(data[c])
        text = np.frombuffer(b"".join(pieces) + bytes(256), np.uint8)
        words = _words(text)
        ranks = cover_ranks(text, words, total)
        counts = meta[4][cols] - meta[3][cols] + 1
        col = np.repeat(np.arange(len(cols)), counts)
        off = np.arange(len(col)) - np.repeat(np.cumsum(counts) - counts, counts)
        pos = np.array(starts, np.int64)[col] + off
        col = cols[col]
        # one suffix sub-bucket: anchor, offset to it and the bytes up to the next sample; then the cover rank
        shift = SHIFT[pos % PERIOD]
        start = meta[3][col] + off
        anchor = np.cumsum(np.append(0, np.diff(meta[0][cols]) != 0))
        group = np.repeat(anchor, counts) * length + (meta[5][col] - start)
        lead = (words[pos] >> (np.uint64(64) - np.uint64(8) * shift.astype(np.uint64)).clip(0, 63)) * (shift > 0)
        key = (group.astype(np.uint64) << np.uint64(40)) | lead
        by = np.lexsort((ranks[pos + shift], key))
        p = pos[by]
        at = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        for k in [*range(0, length - 8, 8), length - 8]:  # whole bytes decide
            at = at[words[p[at] + k] == words[p[at + 1] + k]]
        eq = np.zeros(len(p), bool)
        eq[at + 1] = True
        # rows are in document order, so the least row of a class is its first member
        least = np.minimum.reduceat(by, np.flatnonzero(~eq))
        least.sort()
        # runs of consecutive starts
        new = np.append(True, (col[least[1:]] != col[least[:-1]]) | (start[least[1:]] != start[least[:-1]] + 1))
        at = np.flatnonzero(new)
        out.append(np.stack([col[least[at]], start[least[at]], start[least[np.append(at[1:], len(least)) - 1]]]))
    return np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)


def _sort_bucket(buckets: int, length: int):
    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        blocks = t.column("block").to_pylist()
        metas = [np.frombuffer(x, np.int64) for x in t.column("meta").to_pylist()]
        if bucket < 0:  # ranges of tied windows go back to their block as they are
            rows = [(b, 0, m.tobytes()) for b, m in zip(blocks, metas)]
        elif bucket >= buckets:
            metas = [m.reshape(5, -1) for m in metas]
            m = np.concatenate(metas, axis=1)
            block = np.repeat(np.array(blocks, np.int64), [x.shape[1] for x in metas])
            by = np.lexsort((m[4], m[3], block, m[2], m[1], m[0]))
            m, block = m[:, by], block[by]
            lead = np.append(True, (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1]))
            rows = [(b, 1, np.stack([m[3][lead][i], m[4][lead][i], m[4][lead][i]]).tobytes()) for b, i in _split(block[lead])]
        else:
            metas = [m.reshape(6, -1) for m in metas]
            m = np.concatenate(metas, axis=1)
            block = np.repeat(np.array(blocks, np.int64), [x.shape[1] for x in metas])
            data = []
            for x, blob in zip(metas, t.column("data").to_pylist()):
                at = 0
                for n in (x[4] - x[3] + length).tolist():
                    data.append(blob[at : at + n])
                    at += n
            found = firsts(np.concatenate([m, block[None]]), data, length)
            rows = [(b, 1, np.stack([m[2][found[0][i]], found[1][i], found[2][i]]).tobytes()) for b, i in _split(block[found[0]])]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "runs": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _remove(length: int, texts_too: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = _documents(docs) if docs.num_rows else ([], [])
        kinds, blobs = found.column("kind").to_pylist(), [np.frombuffer(x, np.int64) for x in found.column("runs").to_pylist()]
        ranges = np.concatenate([np.empty((3, 0), np.int64), *(b.reshape(3, -1) for k, b in zip(kinds, blobs) if k == 0)], axis=1)
        first = np.concatenate([np.empty((3, 0), np.int64), *(b.reshape(3, -1) for k, b in zip(kinds, blobs) if k == 1)], axis=1)
        ranges, first = ranges[:, np.argsort(ranges[0], kind="stable")], first[:, np.argsort(first[0], kind="stable")]
        docs_at = np.arange(len(ids) + 1)
        r_at, f_at = np.searchsorted(ranges[0], docs_at), np.searchsorted(first[0], docs_at)
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, text in enumerate(texts):
            n, removed, spans, kept = len(text), 0, 0, text
            if r_at[i] < r_at[i + 1]:
                step = np.zeros(n + 2, np.int32)
                lo, hi = ranges[1, r_at[i] : r_at[i + 1]], ranges[2, r_at[i] : r_at[i + 1]]
                np.add.at(step, lo, 1)
                np.add.at(step, hi + 1, -1)
                marked = np.cumsum(step)[:n] > 0
                step[:] = 0
                np.add.at(step, first[1, f_at[i] : f_at[i + 1]], 1)
                np.add.at(step, first[2, f_at[i] : f_at[i + 1]] + 1, -1)
                marked &= np.cumsum(step)[:n] == 0
                s = np.flatnonzero(marked)
                if len(s):
                    step = np.zeros(n + length + 1, np.int32)
                    step[s] += 1
                    step[s + length] -= 1
                    gone = np.cumsum(step)[:n] > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows["doc_id"].append(None if ids[i] == NONE else ids[i])
            rows["n_bytes"].append(n)
            rows["n_removed"].append(removed)
            rows["n_spans"].append(spans)
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["kept"].append(kept if texts_too else None)
        types = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in rows.items()})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (keep_text) the remaining bytes of each document.

    length at least 40. block_bytes and bucket_bytes bound what one Python call holds; hot bounds a group of anchors.
    """
    spark = docs.sparkSession
    size = total_bytes(docs, text_col)
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // (2 * bucket_bytes)))
    parts = max(min(blocks, parallelism(spark)), -(-blocks // 8))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(parts, "block")
    keys = base.groupBy("block").applyInArrow(_block_anchors(buckets, length), "bucket long, block long, keys binary")
    ties = keys.groupBy("bucket").applyInArrow(_ties(hot), "block long, tied binary")
    sent = base.groupBy("block").cogroup(ties.groupBy("block")).applyInArrow(_segments(buckets, length), "bucket long, block long, meta binary, data binary")
    found = sent.groupBy("bucket").applyInArrow(_sort_bucket(buckets, length), "block long, kind int, runs binary")
    out = base.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(length, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


#: Every window by its digest, every byte by the windows that cover it.
ORACLE_SQL = """
with t as (select row_number() over (order by doc_id nulls last, text) as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select r, unnest(regexp_extract_all(h, '..')) as x, unnest(range(0, length(h) // 2)) as k from t),
w as (select r, unnest(range(0, length(h) // 2 - 99)) as k, unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) as win from t where length(h) >= 200),
f as (select r, k, row_number() over (partition by win order by r, k) > 1 as dup from w),
m as (select b.r, b.k, b.x, coalesce(bool_or(dup) over (partition by b.r order by b.k rows between 99 preceding and current row), false) as gone from b left join f on b.r = f.r and b.k = f.k),
s as (select *, gone and not coalesce(lag(gone) over (partition by r order by k), false) as new from m),
g as (select r, count(*) as n, count(*) filter (gone) as gone, count(*) filter (new) as spans, coalesce(string_agg(x, '' order by k) filter (not gone), '') as kept from s group by r)
select doc_id, coalesce(n, 0)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from t left join g on t.r = g.r
"""
