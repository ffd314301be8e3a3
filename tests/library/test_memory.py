"""What a Python worker holds follows neither the rows of an Arrow batch nor the length of a text."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from sedimenta.batches import pieces
from sedimenta.operators import blobs, corpus, routing


def batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pieces_keep_all_rows():
    texts = ["ab" * 5, None, "", "c" * 50, "d", "é" * 10, "e" * 3]
    got = list(pieces(batches(texts), 0, 20))
    assert [x for b in got for x in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(x.encode()) for x in b.column(0).to_pylist() if x) <= 20 for b in got)
    assert sum(b.num_rows for b in pieces(batches([]), 0, 20)) == 0


@pytest.mark.parametrize("once", [False, True])
def test_grams_of_small_pieces(once):
    r = random.Random(3)
    texts = ["".join(r.choices("abcé", k=r.randrange(200))) for _ in range(60)] + ["", None, "abc", "ab" * 500]
    want = Counter()
    for x in texts:
        b = (x or "").encode()
        grams = [int.from_bytes(b[i : i + 4]) for i in range(len(b) - 3)]
        want.update(set(grams) if once else grams)
    for piece, most in ((1, 1), (16, 40), (64, 5), (1 << 20, 1 << 19)):
        got = Counter()
        for v, k in corpus._counted(batches(texts), 4, once, piece, most):
            assert len(set(v.tolist())) == len(v)
            got.update(dict(zip(v.tolist(), k.tolist())))
        assert got == want


class Captured:
    """In place of a DataFrame: keeps the function that the workers would run."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema = spark, schema

    def __getattr__(self, _):
        return lambda *a, **k: self

    def mapInArrow(self, f, _):
        self.run = f
        return self


def test_grams_of_a_large_batch(spark):
    df = Captured(spark, spark.createDataFrame([("a",)], "text string").schema)
    for once in (False, True):
        corpus._gram_counts(df, "text", 4, once)
        texts = ["".join(random.Random(i).choices("abcdef gh", k=4000)) for i in range(4000)]  # 16 MB
        assert peak(lambda: [0 for _ in df.run(batches(texts))]) < 80 << 20


def keyed(n, size):
    texts = ["".join(random.Random(i).choices("abcdef gh", k=size)) for i in range(n)]
    return texts, pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def test_trials_of_a_large_batch(spark):
    df = Captured(spark, spark.createDataFrame([(1, "a")], "id long, text string").schema)
    names = ("baseline", "lz4", "rle")
    for n, size in ((2500, 20), (300, 10_000)):
        routing.trials(df, "id", "text", names)
        got = list(df.run(iter([keyed(n, size)[1]])))
        assert [(r["id"], r["trial"], r["raw_size"]) for b in got for r in b.to_pylist()] == [(i, t, size) for i in range(n) for t in names]
        assert max(b.num_rows for b in got) <= 3 * min(1000, (1 << 20) // size)


def test_transforms_of_a_large_batch(spark):
    df = Captured(spark, spark.createDataFrame([(1, "a")], "id long, text string").schema)
    for name, size, n in (("rle", 20, 2500), ("mtf", 10_000, 300)):
        texts, batch = keyed(n, size)
        blobs.apply(df, "text", name)
        got = list(df.run(iter([batch])))
        assert max(b.num_rows for b in got) <= min(1000, (1 << 20) // size)
        blobs.apply(df, "encoded", name, True, "back")
        assert [(r["id"], r["text"], r["back"].decode()) for b in df.run(iter(got)) for r in b.to_pylist()] == [(i, x, x) for i, x in enumerate(texts)]
