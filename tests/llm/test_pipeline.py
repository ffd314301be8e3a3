import hashlib
import random
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from sedimenta.llm import byte_bpe, mixing, secret_scan
from sedimenta.llm.quality_rules import features

from test_minhash import brute as near_brute


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinshrdlucmf") for _ in range(r.randint(2, 9)))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(r.choice([20, 60, 90, 200])))
        if i % 7 == 0:
            text += f" password={r.randrange(10**12):012d} end"
        if i % 11 == 0:
            text = "one two three " * 40
        rows.append((i, text, "aa", f"s{i % 4}", len(text)))
    for i in range(120, 160):
        words = rows[r.randrange(100)][1].split()
        words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words), "aa", f"s{i % 4}", 0))
    return rows + [(200, None, None, None, None), (201, rows[3][1], "aa", "s1", 1), (201, rows[3][1], "aa", "s1", 1)]


def expected(spark, rows):
    rows = [x for x in rows if (f := features(x[1] or ""))[0] >= 50 and 100 * f[5] <= 50 * f[0]]
    first = Counter(x[0] for x in near_brute([(x[0], x[1]) for x in rows]))
    kept, seen = [], set()
    for x in rows:
        if x[0] in first and x[0] not in seen:
            kept.append(x)
            seen.add(x[0])
    masked = [(*x[:1], secret_scan.masked(x[1], secret_scan.spans_of(x[1], secret_scan.fitted()), "[SECRET]"), *x[2:]) for x in kept]
    words, total = {}, Counter()
    for x in masked:
        words[x[0]] = len(x[1].split())
        total[x[3]] += words[x[0]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    target, left = {}, dict(total)
    while left:
        share = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if share * weight[s] > 2 * left[s]]
        if not full:
            target |= {s: share * weight[s] for s in left}
            break
        for s in full:
            target[s] = 2.0 * left.pop(s)
    out = Counter()
    used = Counter()
    for x in sorted(masked, key=lambda x: hashlib.md5(f"{x[0]}:{mixing.SEED}".encode()).hexdigest()):
        goal = int(target[x[3]] + 0.5)
        whole = goal // total[x[3]]
        out[x[0]] = whole + (used[x[3]] < goal - whole * total[x[3]])
        used[x[3]] += words[x[0]]
    return {x[0]: x[1] for x in masked}, +out


def test_whole_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    texts, copies = expected(spark, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == copies
    path, pattern = byte_bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.codec(path, pattern).ranks, special_tokens={})
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
