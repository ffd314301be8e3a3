import random
from collections import Counter

import numpy as np

from sedimenta.llm.minhash import HASHES, MISS, drop_near_duplicates, ensemble, like_jaccard, missed, near_duplicates, partition_of, probe_plan, tune


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, t=0.8):
    """Classes, each with the doc_id that stays first. Text nodes are those of Spark's xxhash64, for ties of size."""
    texts = sorted({x or "" for _, x in rows})
    sets = [shingles(x) for x in texts]
    n = len(texts)
    up, up2 = list(range(n)), list(range(n))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    holders = []
    for i in range(n):
        for j in range(n):
            a, b = sets[i], sets[j]
            if i != j and a and len(a) <= len(b) and len(a & b) >= t * len(a) - 1e-9:
                if len(a & b) >= t * len(b) - 1e-9:
                    up[root(up, i)] = root(up, j)
                else:
                    holders.append((i, j))
    label = [root(up, i) for i in range(n)]
    up2 = list(label)
    best = {}
    for i, j in holders:
        if label[i] != label[j]:
            best[label[i]] = max(best.get(label[i], (0,)), (len(sets[j]), label[j]))
    for i, (_, j) in best.items():
        up2[root(up2, i)] = root(up2, j)
    out = {}
    for d, x in rows:
        i = texts.index(x or "")
        out.setdefault(root(up2, i), []).append((label[i] in best, d is None, d))
    return sorted(([min(x)[2], *sorted((d for *_, d in x), key=lambda d: (d is None, d))] for x in out.values()), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 9, 20, 60, 200, 400])))))
    for i in range(n, n + 120):
        words = rows[r.randrange(len(rows))][1].split()
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            k = r.randrange(len(words) + 1)
            words[k : k + r.randint(0, 1)] = [r.choice(vocab)]
        rows.append((i, " ".join(words)))
    base = rows[n - 1][1].split() * 1 or ["x"]
    base = [r.choice(vocab) for _ in range(300)]
    for i in range(90):  # a chain in which each is near the next only
        base = base[4:] + [r.choice(vocab) for _ in range(4)]
        rows.append((1000 + i, " ".join(base)))
    # quotations: a text in longer ones, a hub that two different texts quote, and a quoted near copy
    long = [" ".join(r.choice(vocab) for _ in range(k)) for k in (260, 310, 500)]
    rows += [(3000 + i, x) for i, x in enumerate(long)]
    rows += [(2990, rows[7][1] + " " + long[0]), (2991, " ".join(long[2].split()[100:220])), (2992, " ".join(long[2].split()[100:215])), (3010, " ".join(long[1].split()[:30]))]
    rows += [(3011, " ".join(long[1].split()[:30]) + " " + " ".join(r.choice(vocab) for _ in range(90)))]
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "é ß"), (2004, "é  ß"), (None, rows[0][1]), (None, "only one of its kind here"), (5, rows[5][1])]
    return rows


def classes(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    got = {}
    for r in near_duplicates(df).collect():
        got.setdefault((r.label, r.class_id), []).append(r.doc_id)
    return sorted(([k[1], *sorted(x, key=lambda d: (d is None, d))] for k, x in got.items()), key=str)


def test_classes_match_brute_force(spark):
    rows = corpus(1)
    assert classes(spark, rows) == brute(rows)


def test_large_groups(spark):
    r = random.Random(4)
    base = ["v%d" % r.randrange(5000) for _ in range(250)]
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(250)] = "z%d" % i
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(corpus(9, 30)[:60])]
    assert classes(spark, rows) == brute(rows)


def test_drop_keeps_one_of_each(spark):
    rows = corpus(2, 80)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, near_node int")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    want = Counter(x[0] for x in brute(rows))
    assert Counter(r.doc_id for r in out.collect()) == want


def test_a_shared_passage_joins_nothing(spark):
    """A passage in many texts: only the text that is the passage joins one of them; the copies of one text are one class."""
    r = random.Random(6)
    passage = " ".join("p%d" % r.randrange(900) for _ in range(24))
    own = [" ".join("q%d" % r.randrange(10**6) for _ in range(60)) for _ in range(120)]
    rows = [(i, f"{own[i]} {passage} {own[119 - i]}") for i in range(60)] + [(500, passage), (501, passage + " end")]
    rows += [(600 + i, rows[3][1].replace("q", "r", 1) + f" x{i}") for i in range(40)]
    assert classes(spark, rows) == brute(rows)


def test_very_long_and_repeated_rows(spark):
    r = random.Random(8)
    long = ["u%d" % r.randrange(10**6) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[100:200])), (4, "x" * 300_000), (4, "x" * 300_000)]
    assert classes(spark, rows) == brute(rows) == [[1, 1, 1, 2, 3], [4, 4, 4]]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, near_node int")
    assert sorted(x.doc_id for x in drop_near_duplicates(df).collect()) == [1, 4]


def test_tables_are_removed(spark):
    import os

    from sedimenta.llm.common import shared_dir

    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string")
    where = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where))
    near_duplicates(df).collect()
    assert [x.split("-")[1] for x in set(os.listdir(where)) - before] == ["classes"]


def test_empty_and_tuning(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and drop_near_duplicates(df).count() == 0
    assert like_jaccard((1, 4)) == 1 and abs(like_jaccard((17, 64)) - 2 / 3) < 1e-9
    assert [partition_of(n) for n in (1, 4, 5, 16, 17, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
    plans = ensemble(5)
    assert len({s for (p, q), (s, _, _) in plans.items() if p != q}) == 10  # every pair of partitions has its own threshold
    assert all(plans[p, q][0] > plans[p, q + 1][0] and plans[p, q][2] < plans[p, q + 1][2] for p in range(4) for q in range(p + 1, 4))


def test_misses_are_as_tuned():
    """Simulated pairs at the threshold: the bands share their minima."""
    g = np.random.default_rng(1)
    s = like_jaccard((65, 256))
    rows, bands = tune(s)
    choice = np.stack([g.choice(HASHES, rows, replace=False) for _ in range(bands)])
    hit = g.random((20_000, HASHES)) < s
    lost = 1 - np.mean([hit[i][choice].all(axis=1).any() for i in range(len(hit))])
    assert lost <= 2 * MISS and abs(lost - missed(s, rows, bands)) < 1e-3
    k, least = probe_plan(100)
    assert np.mean(g.binomial(k, 0.8, 10**6) < least) <= MISS
    assert [probe_plan(n) for n in (1, 5, 10, 64)] == [(1, 1), (5, 4), (10, 8), (64, 52)]


def test_bit_arrays_grow_with_the_input(spark):
    """What passes the bits by chance is sent: in a fixed array that becomes every shingle of a large table."""
    from sedimenta.llm.minhash import bits_of, has_bits, log_bits

    assert all(2 ** log_bits(n) >= 14 * n for n in (10**5, 6 * 10**6, 72 * 10**6)) and log_bits(10**10) == 30
    for n in (300, 300_000):
        numbers = np.random.default_rng(n).integers(-(2**63), 2**63, 2 * n)
        bits = bits_of(spark.createDataFrame([(x,) for x in numbers[:300].tolist()], "v long") if n == 300 else spark.range(n).selectExpr("xxhash64(id) as v"), n)
        if n == 300:
            assert has_bits(bits, numbers[:300]).all()
        assert len(bits) == 2 ** log_bits(n) // 8 and has_bits(bits, numbers[n:]).mean() < 0.02


def test_containers_behind_a_larger_text_with_the_same_minima(spark):
    """Many texts have all minima of one text, but little else of it; the text that contains it is not the largest of them."""
    from sedimenta.llm.minhash import PROBES, shingle_sets

    r = random.Random(12)
    words = ["p%d" % r.randrange(10**6) for _ in range(400)]
    own = lambda n: ["q%d" % r.randrange(10**9) for _ in range(n)]
    windows = [words[i : i + 5] for i in range(396)]
    least = sorted(windows, key=lambda w: shingle_sets([" ".join(w).encode()])[0][0])[:PROBES]
    rows = [(900, " ".join(words)), (901, " ".join(words + own(150)))]
    for i in range(30):
        rows.append((i, " ".join(w for x in least for w in x + own(25 + i % 3))))
    want = brute(rows)
    assert [901, 900, 901] in want and classes(spark, rows) == want


def test_copies_count_once(spark, monkeypatch):
    """Copies of a text in several tasks send a shingle that is hot in each; counted as often, they made any text that shares a passage a candidate."""
    from sedimenta.llm.common import Tables

    r = random.Random(13)
    own = lambda n: " ".join("q%d" % r.randrange(10**9) for _ in range(n))
    passage = own(12)
    rows = [(i, f"{own(20)} {passage} {own(20 + i)}") for i in range(70)] + [(100, f"{passage} {own(4)}"), (101, f"{passage} end")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows * 3, 3), "doc_id long, text string")  # all texts in each task
    text = dict(df.selectExpr("xxhash64(text)", "text").collect())
    tried, keep = set(), Tables.keep

    def watched(self, df, what):
        out = keep(self, df, what)
        if what in ("near-seen", "near-others"):
            tried.update((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(Tables, "keep", watched)
    got = {}
    for x in near_duplicates(df).collect():
        got.setdefault(x.class_id, []).append(x.doc_id)
    assert sorted(([k, *sorted(v)] for k, v in got.items()), key=str) == brute(rows * 3)
    assert {text[a] for a, _ in tried} == {f"{passage} end"}


def test_sixteen_bits_lose_no_link():
    import pyarrow as pa

    from sedimenta.llm.minhash import _contained

    g = np.random.default_rng(3)
    b = np.unique(g.integers(0, 2**64, 9000, dtype=np.uint64))
    a = np.unique(np.concatenate([g.choice(b, 80, replace=False), g.integers(0, 2**64, 300, dtype=np.uint64)]))
    for p, q in ((a, b), (b, a)):
        shared = []
        for kind, shift in ((np.uint64, 0), (np.uint16, 48)):
            row = [pa.array([1]), pa.array([2]), pa.array([len(p)]), pa.array([len(q)]), *(pa.array([(v >> np.uint64(shift)).astype(kind).tobytes()]) for v in (p, q))]
            shared.append(next(_contained(kind)([pa.RecordBatch.from_arrays(row, names=["a", "b", "na", "nb", "sa", "sb"])])).column("shared")[0].as_py())
        assert shared[0] == 80 <= shared[1] < 160
