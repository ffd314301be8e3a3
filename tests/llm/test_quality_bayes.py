import random

import numpy as np
import pytest

from sedimenta.llm.quality_bayes import NAMES, classify, evidence_features, fit


def doc(r, good):
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200))]
    return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + r.choice(["!!", "", "$"]) for w in words)


def data(n=600):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        host = f"h{i % 6}"
        good = r.random() < (0.2 if host == "h0" else 0.95)
        rows.append((i, doc(r, good), "aa" if i % 2 else "bb", host, 1.0))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
        rows[-1] = (*rows[-1][:4], float(good))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_evidence_and_sites(spark):
    rows, labels = data()
    docs, given = frames(spark, rows, labels)
    got = {r.doc_id: r for r in classify(docs, given).collect()}
    truth = {r[0]: r[4] for r in rows}
    seen = {x[0] for x in labels}
    unseen = [i for i in truth if i not in seen]
    assert np.mean([got[i].kept == bool(truth[i]) for i in unseen]) > 0.97
    assert np.mean([got[i].kept for i in unseen if truth[i]]) > 0.98
    rate = lambda h: np.mean([got[r[0]].host_rate for r in rows if r[3] == h])
    assert rate("h0") < 0.4 and rate("h3") > 0.8
    # with equal evidence the site decides: odds are the site's over the whole's
    a, b = got[0], got[3]
    odds = lambda p: p / (1 - p)
    ratio = [odds(r.quality) / odds(r.evidence) / odds(r.path_rate) for r in (a, b)]
    assert ratio[0] == pytest.approx(ratio[1], rel=1e-6)


def test_sparse_sites_shrink(spark):
    rows, labels = data()
    r = random.Random(9)
    rows += [(9000, doc(r, False), "aa", "lonely", 0.0), (9001, doc(r, True), "zz", "h1", 1.0), (9002, None, None, None, 0.0), (None, doc(r, True), "aa", "h1", 1.0)]
    docs, given = frames(spark, rows, labels)
    out = classify(docs, given).collect()
    got = {x.doc_id: x for x in out}
    assert len(out) == len(rows)
    whole = np.mean([x.evidence for x in out])
    assert abs(got[9000].host_rate - whole) < 0.05  # without itself the site knows nothing
    assert abs(got[9001].path_rate - got[9001].host_rate) < 1e-9
    assert got[9002].evidence is not None and 0 <= got[9002].quality <= 1


def test_order_of_rows_does_not_matter(spark):
    rows, labels = data(200)
    docs, given = frames(spark, rows, labels)
    a = {r.doc_id: r.quality for r in classify(docs.repartition(1), given).collect()}
    b = {r.doc_id: r.quality for r in classify(docs.repartition(7), given.repartition(3)).collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_no_labels_and_empty(spark):
    rows, labels = data(30)
    docs, given = frames(spark, rows, labels)
    assert all(r.kept for r in classify(docs, given.limit(0)).collect())
    assert classify(docs.limit(0), given).collect() == []


def test_fit_and_features():
    g = np.random.default_rng(1)
    x = g.standard_normal((2000, 3))
    y = (g.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    w = fit(x, y, 1e-6)["weights"]
    assert w[0] == pytest.approx(2, abs=0.3) and w[1] == pytest.approx(-1, abs=0.2) and abs(w[2]) < 0.2
    assert len(evidence_features("")) == len(evidence_features("A b!")) == len(NAMES)


def test_distinct_words_of_the_whole_text():
    at = NAMES.index("unique")
    start = [f"w{i}" for i in range(400)]
    whole = lambda words: evidence_features(" ".join(words))[at]
    assert whole(start) == 1 and whole(start + ["x"] * 400) == pytest.approx(401 / 800)
    assert whole(start + [f"v{i}" for i in range(450)]) == 1
    assert whole(start + ["x", "x", "y", "x"]) == pytest.approx(402 / 404)
    assert whole(["a", "b", "a"]) == pytest.approx(2 / 3) and whole([]) == 0
