import random

import numpy as np

from sedimenta.llm.language_id import BITS, ORDER, Model, grams, hashed, identify, learn, letters, op6_language_id, sample, symbols

PARTS = {"aa": "the ing an on er re th sh".split(), "bb": "que eau ion ç é les ou ai".split(), "cc": "ung ein sch ß ä ie ch en".split()}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_distributions_sum_to_one():
    s = [np.random.default_rng(i).integers(0, 9, 300).astype(np.uint16) for i in range(3)]
    m = Model.of(s)
    for context in (grams(s[0], ORDER)[5] >> np.uint64(BITS), (60 << 32) | (1 << 16) | 2, 7):
        codes = (np.uint64(context) << np.uint64(BITS)) | np.arange(1 << BITS, dtype=np.uint64)
        assert abs(m.probability(codes).sum() - 1) < 1e-9
    for codes, _, contexts, _ in m.levels:
        assert (codes[1:] > codes[:-1]).all() and (contexts[1:] > contexts[:-1]).all()


def test_against_plain_kneser_ney():
    s = np.array([0, 0, 0, 2, 3, 2, 3, 4, 0, 2, 4, 0], np.uint16)
    m, seq, d = Model.of([s], 0.75), s.tolist(), 0.75
    occur = {n: [tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)] for n in range(1, ORDER + 1)}

    def count(gram):
        if len(gram) == ORDER:
            return occur[ORDER].count(gram)
        return len({g for g in kinds[len(gram) + 1] if g[1:] == gram})

    kinds = {ORDER: set(occur[ORDER])}
    for n in range(ORDER - 1, 0, -1):
        kinds[n] = {g[1:] for g in kinds[n + 1]}

    def p(gram):
        if not gram:
            return 1 / 65536
        follow = [g for g in kinds[len(gram)] if g[:-1] == gram[:-1]]
        low = p(gram[1:])
        if not follow:
            return low
        total = sum(count(g) for g in follow)
        return max(count(gram) - d, 0) / total + d * len(follow) / total * low if gram in kinds[len(gram)] else d * len(follow) / total * low

    for gram in [(0, 0, 0, 2), (2, 3, 2, 3), (2, 3, 4, 0), (4, 4, 4, 4), (0, 2, 3, 9), (3, 4, 0, 4)]:
        code = np.uint64(sum(x << BITS * (ORDER - 1 - i) for i, x in enumerate(gram)))
        assert abs(m.probability(np.array([code]))[0] - p(gram)) < 1e-12


def test_symbols():
    assert symbols("  Aé-- b1").tolist() == [0, 0, 0, 97, 233, 0, 98, 0]
    assert symbols("").tolist() == [0, 0, 0, 0] and letters()[ord("É")] == ord("é")
    assert symbols("𐐀漢")[3:].tolist() == [0xD800 + 0x10428 % 2048, ord("漢"), 0]
    codes = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert len(np.unique(hashed(codes))) == len(np.unique(codes))


def test_every_script_has_its_letters(spark):
    """Ten languages, two in each of five scripts, that differ in the order of letters only."""
    data = []
    for script, (first, size) in enumerate([(0x61, 26), (0x430, 32), (0x3B1, 24), (0x561, 38), (0x10D0, 33)]):
        for k in range(2):
            r = random.Random(script * 2 + k)
            parts = ["".join(chr(first + r.randrange(size)) for _ in range(3)) for _ in range(40)]
            data += [(len(data) + i, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(25)), f"l{script}{k}") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, learn(sample(df))).collect()}
    held = [x for x in data if got[x[0]].held_out]
    assert len(held) > 60 and all(got[i].lang_pred == lang for i, _, lang in held)


def test_ties_and_repeated_rows(spark):
    same = [(i, "abc abd abe acd", lang) for i in range(1, 9) for lang in ("y", "x")]
    df = spark.createDataFrame(same + same, "doc_id long, text string, lang string")
    got = identify(df, learn(sample(df))).collect()
    assert len(got) == 32 and {(r.lang_pred, r.score) for r in got} == {("x", 0.5)}


def rows():
    return [(i, text(lang, 30, i), lang, 1) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows() + [(900, None, "aa", 1), (901, " 12 !", "bb", 1), (902, "", None, 1), (None, text("bb", 20, "z"), None, 1), (903, "x" * 400_000, "cc", 1), (904, "漢字" * 30, None, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score int")
    learned = sample(df)
    assert {r.lang for r in learned.select("lang").distinct().collect()} == {"aa", "bb", "cc"}
    got = {r.doc_id: r for r in identify(df, learn(learned)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows())
    assert sum(r.held_out for r in got.values()) > 20
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert not got[904].accepted and np.mean([got[i].accepted for i, *_ in rows()]) > 0.9


def test_sample_is_bounded_and_leaves_out_held_out(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score int")
    some = sample(df, most=10)
    assert {r.lang: r["count"] for r in some.groupBy("lang").count().collect()} == {"aa": 10, "bb": 10, "cc": 10}
    import zlib

    held = {t for i, t, *_ in rows() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & {r.text for r in sample(df).collect()}


def test_nothing_to_learn(spark, tmp_path):
    spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.lang_pred, r.score) for r in op6_language_id(spark, str(tmp_path)).collect()] == [("und", 0.0)]
    assert identify(spark.createDataFrame([], "doc_id long, text string"), {"langs": [], "models": []}).collect() == []
