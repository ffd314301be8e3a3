import hashlib
import random

from sedimenta.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "é", "than", "ing", "on", "ü", "ab", "xyz", "aa", "straße"]
    passages = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(passages)[r.randint(0, 40) :])
        rows.append((i * 7 % 1009, " ".join(parts)))
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (5002, "a" * 3000), (5003, None), (5004, ""), (5005, "a" * 150), (None, rows[3][1]), (5006, "ab" * 400)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string")
    got = remove_repeats(df, **kw).drop("kept").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0]))


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows, 100)


def test_small_blocks_and_hot_anchors(spark):
    rows = corpus(2)
    want = brute(rows, 100)
    assert run(spark, rows, block_bytes=3000, bucket_bytes=500) == want
    assert run(spark, rows, block_bytes=3000, bucket_bytes=500, hot=4) == want


def test_other_length_and_kept_text(spark):
    rows = corpus(3, 40)
    assert run(spark, rows, length=48, block_bytes=2000) == brute(rows, 48)
    df = spark.createDataFrame([(1, "x" * 10)], "doc_id long, text string")
    assert remove_repeats(df).first()["kept"] == b"x" * 10


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_text_over_piece(spark):
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, a + a[400_000:400_500]), (2, a[524_200:524_400]), (3, a[: 600_000])]
    assert run(spark, rows) == brute(rows, 100)
