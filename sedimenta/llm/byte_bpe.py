"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

Texts are split by the public pattern; each distinct piece of a batch is encoded once. Pieces that are a
token are looked up. The others become token-position rows of a recursive query: rows join the merge table with their
right neighbour, every piece contracts its leftmost pair of least rank, and a piece stays behind once it has none.
Decoding joins (document, position, id) rows with the vocabulary and aggregates the bytes in order.

The recursion takes a step for each contraction and a row for each token in it, so it is quadratic in a piece's
length; pieces over LONG bytes are contracted by the same rule with a queue of pairs instead. Pieces that were
encoded are kept by worker, at most KEEP of them. The recursion keeps every turn's rows, some half of the square of a
piece's bytes, so a batch of new pieces is cut where these squares add up to STEP: it fits the memory of DuckDB, which
may not spill to the worker's disk. Nothing is shuffled.

The rank file is a parameter; the driver checks it and workers read it where it lies. Nulls and edge
cases: a null text is encoded as empty, with no ids; lone special-token strings are ordinary text; extra columns
are ignored by encode() and kept by with_token_ids(); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_file, release, small_batches, table, text_or_empty

LONG, KEEP, STEP, SLICE, DECODE = 64, 300_000, 2 << 20, 1 << 20, 200_000
#: White space as Unicode has it, and as the library's \s does; Python's adds U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str):
    import regex

    outside = pattern.replace(r"[^\s", rf"[^{_WHITE}").replace(r"\S", rf"[^{_WHITE}]")
    return regex.compile(outside.replace(r"\s", rf"[{_WHITE}]"))


#: Rows of step: key = piece << 8 | position of the token's first byte. pair has the merged token above the key.
_ENCODE = """
with recursive step(key, token, turn) as (
  select (piece::bigint << 8) | pos, token, 0 from start
  union all (
  with pairs as materialized (
    select s.key, s.token, s.turn, s.next_key, (m.token::bigint << 40) | s.key as pair
    from (select key, token, turn, lead(token) over neighbour as next, lead(key) over neighbour as next_key from step window neighbour as (order by key)) s
    left join merges m on m.a = s.token and m.b = s.next and s.next_key >> 8 = s.key >> 8),
  best as (select key >> 8 as piece, min(pair) as best, arg_min(next_key, pair) as gone from pairs where pair is not null group by key >> 8)
  select p.key, case when p.pair = b.best then b.best >> 40 else p.token end::int, turn + 1
  from pairs p join best b on p.key >> 8 = b.piece where p.key <> b.gone))
select (key >> 8)::int as piece, token
from (select *, max(turn) over (partition by key >> 8) as last from step) where turn = last order by key
"""


class Pieces(dict):
    """Numbers of pieces in the order of their first sight; the new ones wait in a list."""

    def __init__(self, names=()):
        super().__init__(zip(names, range(len(names))))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Codec:
    """Ranks in DuckDB tables, and the pieces that this worker has encoded."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = compiled(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "160MB", "temp_directory": ""})
        at = self.ranks.get
        # every split of a token into two tokens; equal bytes have equal ranks, whatever their parts
        flat = np.fromiter((n for t, k in self.ranks.items() for i in range(1, len(t)) if (x := at(t[:i])) is not None and (y := at(t[i:])) is not None for n in (x, y, k)), np.int32).reshape(-1, 3)
        m = pa.table({c: pa.array(np.ascontiguousarray(flat[:, i])) for i, c in enumerate(("a", "b", "token"))})
        v = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})
        self.con.register("m", m)
        self.con.register("v", v)
        self.con.execute("create table merges as from m")
        self.con.execute("create table vocabulary as from v")
        for name in ("m", "v"):
            self.con.unregister(name)
        del flat, m, v
        release()
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known = Pieces()
        self.tokens, self.ends, self.used = np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def forget(self) -> None:
        """Keeps the half of KEEP pieces that were used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: KEEP // 2])
        sizes = self.ends[keep + 1] - self.ends[keep]
        stop = np.cumsum(sizes)
        self.tokens = self.tokens[np.arange(stop[-1]) - np.repeat(stop - sizes - self.ends[keep], sizes)]
        self.ends, self.used = np.append(0, stop), self.used[keep]
        names = list(self.known)
        self.known = Pieces([names[i] for i in keep.tolist()])

    def _queue(self, piece: bytes) -> list[int]:
        """The same contraction for a long piece: a queue of (rank, position) and links between tokens."""
        n, at = len(piece), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, 2) for i in range(n - 1) if (r := at(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = end[i]
            if not alive[i] or j >= n or end[j] - i != size or not alive[j]:
                continue
            alive[j] = False
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
                if (r := at(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(queue, (r, i, end[end[i]] - i))
            if (h := before[i]) >= 0 and (r := at(piece[h : end[i]])) is not None:
                heapq.heappush(queue, (r, h, end[i] - h))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of pieces, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = pa.table({"piece": pa.array(np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)), "pos": pa.array((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)), "token": pa.array(self.byte[np.frombuffer(b"".join(pieces), np.uint8)])})
        self.con.register("start", start)
        found = self.con.execute(_ENCODE).fetchnumpy()
        self.con.unregister("start")
        return np.asarray(found["token"], np.int32), np.bincount(np.asarray(found["piece"]), minlength=len(pieces))

    def learn(self) -> None:
        """Encodes the pieces that wait, in the order of their numbers."""
        pieces, self.known.new = self.known.new, []
        at = self.ranks.get
        tokens: list[np.ndarray] = []
        sizes = np.ones(len(pieces), np.int64)
        lone, rest, coded = [], [], []
        place: list[int] = []
        for i, p in enumerate(pieces):
            data = p.encode()
            if (r := at(data)) is not None:
                lone.append(r)
                place.append(i)
            elif len(data) <= LONG:
                rest.append(i)
                coded.append(data)
        tokens.append(np.array(lone, np.int32))
        done = set(place) | set(rest)
        for i in (i for i in range(len(pieces)) if i not in done):
            tokens.append(np.array(self._queue(pieces[i].encode()), np.int32))
            sizes[i] = len(tokens[-1])
            place.append(i)
        steps = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) ** 2) // STEP
        cuts = np.append(np.flatnonzero(np.diff(steps, prepend=-1)), len(coded)).tolist()
        for k, end in zip(cuts, cuts[1:]):
            t, n = self._contract(coded[k:end])
            tokens.append(t)
            sizes[rest[k:end]] = n
        order = np.array(place + rest, np.int64)
        flat, n = np.concatenate(tokens), sizes[order]
        # from the order of work to that of numbers
        start = np.empty(len(order), np.int64)
        start[order] = np.cumsum(n) - n
        stop = np.cumsum(sizes)
        self.tokens = np.append(self.tokens, flat[np.arange(len(flat)) - np.repeat(stop - sizes - start, sizes)])
        self.ends = np.append(self.ends, self.ends[-1] + stop)
        self.used = np.append(self.used, np.zeros(len(sizes), np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's end."""
        if len(self.known) > KEEP:
            self.forget()
        number = self.known.__getitem__
        parts = []
        for t in texts:  # strings of pieces live for one text only
            found = self.split(t)
            parts.append(np.fromiter(map(number, found), np.int32, len(found)))
        if self.known.new:
            self.learn()
        which = np.concatenate([np.empty(0, np.int32), *parts])
        self.used += np.bincount(which, minlength=len(self.used))
        size = self.ends[which + 1] - self.ends[which]
        stop = np.cumsum(size)
        ids = self.tokens[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - self.ends[which], size)]
        return ids, np.append(0, stop)[np.cumsum([len(p) for p in parts])]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids, some DECODE ids (or one run) at a time. Raises KeyError for an unknown id."""
        out, i = [], 0
        while i < len(ends):
            low = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, low + DECODE, "right")))
            out += self._decode(ids[low : int(ends[j - 1])], ends[i:j] - low)
            i = j
        return out

    def _decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        sizes = np.diff(np.append(0, ends))
        rows = pa.table({"doc": pa.array(np.repeat(np.arange(len(ends), dtype=np.int32), sizes)), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "token": pa.array(ids.astype(np.int32))})
        self.con.register("ids", rows)
        found = self.con.sql("select doc, list(bytes order by pos) as parts from ids join vocabulary using (token) group by doc").to_arrow_table()
        self.con.unregister("ids")
        out = [b""] * len(ends)
        parts = found.column("parts").combine_chunks()
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.chunk(0) if parts.num_chunks else pa.array([], pa.list_(pa.binary()))
        flat, offsets = parts.flatten(), parts.offsets.to_pylist()
        if len(flat) != len(ids):
            raise KeyError("an id is not in the vocabulary")
        where = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4) if len(flat) else np.zeros(1, np.int32)
        data = flat.buffers()[2].to_pybytes() if len(flat) else b""
        for d, a, b in zip(found.column("doc").to_pylist(), offsets, offsets[1:]):
            out[d] = data[where[a - offsets[0]] : where[b - offsets[0]]]
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return ensure_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def _slices(batch: pa.RecordBatch, most: int = SLICE):
    """Parts of a batch with about most characters each."""
    sizes = [len(t) for t in batch.column("text").to_pylist()]
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids: each whole text's token ids."""
    path, pattern = vocabulary or public_vocabulary()
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for batch in _slices(whole):
                ids, ends = c.encode(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return base.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, data: the bytes of each array of ids (null: empty)."""
    path, pattern = vocabulary or public_vocabulary()
    small_batches(encoded.sparkSession)
    base = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c.decode(ids, ends), pa.binary())], names=["doc_id", "data"])

    return base.mapInArrow(run, "doc_id long, data binary")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes of each text, as digests, in one pass."""
    path, pattern = vocabulary or public_vocabulary()
    small_batches(docs.sparkSession, 2)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for batch in _slices(whole):
                ids, ends = c.encode(batch.column("text").to_pylist())
                coded = ids.astype("<u4")
                starts = np.append(0, ends[:-1]).astype(np.int64)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.array([sha(coded[a:b].tobytes()) for a, b in zip(starts, ends)], pa.string()), pa.array([sha(x) for x in c.decode(ids, ends)], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            release()

    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark, sf_dir) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
