import math
import random
import re
import zlib

import numpy as np
import pytest

from lodequery.llm import quality as Q
from lodequery.llm import queries as L
from lodequery.llm import textfeatures as T
from lodequery.llm import toxicity as X


SF = "/root/testdata/sf0.001"


def corpus(seed=1, n=700):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    docs, quality, toxic = [], [], []
    for k in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(10, 120))]
        grade, bad = r.choice([0, 1, 2]), int(r.random() < 0.25)
        if grade == 0:
            w = [x.upper() + "!!" for x in w]
        elif grade == 1:
            w = [x + "###" if r.random() < 0.3 else x for x in w]
        if bad:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["Blorg", "zwurk,", "fnarp"]))
        docs.append((k, " ".join(w)))
        quality.append((k, grade))
        toxic.append((k, bad))
    return docs, quality, toxic


EXTRA = [(None, "a b"), (5000, None), (5001, ""), (3, "blorg again"), (3, "blorg again")]


def test_ordinal_grades(spark):
    docs, grades, _ = corpus()
    d = spark.createDataFrame([(*x, "x") for x in docs + EXTRA], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(k, g) for k, g in grades if k % 3] + [(None, 1), (1, None), (99999, 2)], "doc_id long, quality int")
    got = Q.quality_scores(d, labels, good=2.0).collect()
    assert len(got) == len(docs) + len(EXTRA)
    truth, held = dict(grades), [r for r in got if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id < 700 and r.doc_id != 3]
    assert np.mean([r.keep == (truth[r.doc_id] == 2) for r in held]) > 0.95
    assert np.mean([round(r.expected_grade) == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.p_good <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert Q.quality_scores(d.limit(0), labels).collect() == []
    assert {r.expected_grade for r in Q.quality_scores(d, labels.limit(0)).collect()} == {0.0}


# Brute force: features as strings, a dense matrix, losses written out and checked against their gradients by differences.

def plain_features(text, shapes):
    lower = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+" if shapes else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    if not shapes:
        return set(words)
    size = max(1, len((text or "").encode()))
    marks = [sum("A" <= c <= "Z" for c in text or ""), sum(c in "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~" for c in text or "")]
    again, n = sum(a == b for a, b in zip(words, words[1:])), max(1, len(words))
    shares = [marks[0] / size, marks[1] / size, again / n, len(set(words)) / n if len(words) > 20 else 1.0]
    return set(words) | {(k, math.ceil(x * 10)) for k, x in enumerate(shares)}


def plain_telling(rows, positive, least, fewest, most):
    out, total, plus = [], len(rows), sum(positive)
    for f in set().union(*rows):
        cells = [[0, 0], [0, 0]]
        for r, p in zip(rows, positive):
            cells[f in r][bool(p)] += 1
        n = sum(cells[1])
        g = sum(2 * c * math.log(c * total / (row * margin)) for have, row in ((1, n), (0, total - n)) for c, margin in ((cells[have][1], plus), (cells[have][0], total - plus)) if c)
        if math.sqrt(max(g, 0)) >= least and n >= fewest:
            out.append((g, f))
    assert len(out) <= most
    return {f for _, f in out}


def dense(rows, keys):
    return np.asarray([[k in r for k in keys] for r in rows], float).reshape(len(rows), len(keys))


def logistic(x):
    return 1 / (1 + np.exp(-np.asarray(x, float)))


def ordinal_loss(x, m, level, k, l2):
    f = m.shape[1]
    t = np.concatenate([[-np.inf], x[f] + np.cumsum([0, *np.exp(x[f + 1 :])]), [np.inf]])
    z = m @ x[:f]
    return -np.log(logistic(t[level + 1] - z) - logistic(t[level] - z)).mean() + l2 * (x[:f] ** 2).sum() / 2 / len(level)


def counterfactual_loss(x, m, swapped, named, y, penalty, l2):
    z = m @ x[:-1] + x[-1]
    change = (swapped - m) @ x[:-1]
    return -(y * np.log(logistic(z)) + (1 - y) * np.log(1 - logistic(z))).mean() + l2 * (x[:-1] ** 2).sum() / 2 / len(y) + penalty * (change**2).sum() / named


def by_differences(loss, x):
    g = np.zeros_like(x)
    for k in range(len(x)):
        e = np.zeros_like(x)
        e[k] = 1e-5
        g[k] = (loss(x + e) - loss(x - e)) / 2e-5
    return g


def test_gradient_of_the_ordinal_loss():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 12, 5) * 2).astype(np.uint64) for _ in range(80)] + [np.zeros(0, np.uint64)]
    level, keys = np.asarray([k % 4 for k in range(81)]), np.arange(12, dtype=np.uint64) * 2
    gradient = Q.OrdinalModel.gradient(T.Sparse(rows, keys), level, 4, 0.7)
    m = dense([set(x.tolist()) for x in rows], keys.tolist())
    for _ in range(3):
        x = 0.3 * r.normal(size=15)
        assert gradient(x) == pytest.approx(by_differences(lambda v: ordinal_loss(v, m, level, 4, 0.7), x), abs=1e-7)


def test_gradient_of_the_counterfactual_loss():
    r = np.random.default_rng(1)
    keys = np.arange(14, dtype=np.uint64) * 2
    term, other = np.asarray([4, 8, 10], np.uint64), np.asarray([8, 10, 4], np.uint64)
    rows = [np.unique(r.integers(0, 14, 4) * 2).astype(np.uint64) for _ in range(90)]
    y = r.integers(0, 2, 90).astype(float)
    m = dense([set(x.tolist()) for x in rows], keys.tolist())
    swapped = m.copy()
    swapped[:, [2, 4, 5]] -= m[:, [2, 4, 5]]
    swapped[:, [4, 5, 2]] += m[:, [2, 4, 5]]
    gradient = X.CounterfactualModel.gradient(T.Sparse(rows, keys), y, keys, term, other, 3.0, 0.4)
    for _ in range(3):
        x = 0.3 * r.normal(size=15)
        assert gradient(x) == pytest.approx(by_differences(lambda v: counterfactual_loss(v, m, swapped, m[:, [2, 4, 5]].any(axis=1).sum(), y, 3.0, 0.4), x), abs=1e-7)


def plain_adam(gradient, x, steps=600, rate=0.05):
    m = v = 0 * x
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return x


def labelled(spark, name, train):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[name] is not None and r.doc_id in docs}
    return docs, [(docs[i], y) for i, y in sorted(labels.items()) if train(i)]


def plain_quality(spark):
    """P(good) of every document, by brute force."""
    docs, rated = labelled(spark, "quality", lambda i: True)
    rows, y = [plain_features(t, True) for t, _ in rated], [int(q) for _, q in rated]
    keys = sorted(plain_telling(rows, y, 3.5, 3, 4096), key=str)
    m, level = dense(rows, keys), np.asarray(y)
    share = np.clip((level == 0).mean(), 1e-4, 1 - 1e-4)

    def gradient(x):  # two grades: P(1) = 1 - logistic(threshold - z)
        d = logistic(x[-1] - m @ x[:-1]) - (level == 0)
        return np.append(-(m.T @ d) + 0.5 * x[:-1], d.sum()) / len(level)

    x = plain_adam(gradient, np.append(np.zeros(len(keys)), np.log(share / (1 - share))))
    assert len(keys) > 3
    return {i: 1 - logistic(x[-1] - dense([plain_features(t, True)], keys) @ x[:-1])[0] for i, t in docs.items()}


def test_op3_against_brute_force(spark):
    want, got = plain_quality(spark), L.op3_ordinal_quality(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.p_good == pytest.approx(want[r.doc_id], abs=1e-6) and r.expected_grade == pytest.approx(want[r.doc_id], abs=1e-6) and r.keep == (r.p_good >= 0.5)


def test_op4_against_brute_force(spark):
    rest = lambda i: zlib.crc32(str(i).encode()) % 3
    docs, rated = labelled(spark, "toxic", lambda i: rest(i) != 1)
    rows, y = [plain_features(t, False) for t, _ in rated], np.asarray([float(q) for _, q in rated])
    swap = {a: b for kind in reversed(X.IDENTITY_TERMS) for a, b in zip(kind, kind[1:] + kind[:1])}
    keys = sorted(plain_telling(rows, y, 4.0, 3, 4096) | set(swap))
    counter = lambda rs: np.asarray([[sum(swap.get(w, w) == k for w in r) for k in keys] for r in rs], float)
    m, c = dense(rows, keys), counter(rows)
    named = max(1, sum(bool(r & set(swap)) for r in rows))

    def gradient(x):
        d = logistic(m @ x[:-1] + x[-1]) - y
        return np.append((m.T @ d + 0.3 * x[:-1]) / len(y) + 20 / named * ((c - m).T @ ((c - m) @ x[:-1])), d.mean())

    x = plain_adam(gradient, np.append(np.zeros(len(keys)), np.log(y.mean() / (1 - y.mean()))))
    got = L.op4_counterfactual_toxicity(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        own = [plain_features(docs[r.doc_id], False)]
        z, s = (dense(own, keys) @ x[:-1] + x[-1])[0], (counter(own) @ x[:-1] + x[-1])[0]
        assert r.score == pytest.approx(logistic(z), abs=1e-6) and r.swap_change == pytest.approx(logistic(s) - logistic(z), abs=1e-6)
        assert r.held_out == (rest(r.doc_id) == 1) and r.predicted == (r.score >= 0.7)


def test_thresholds_stay_ordered():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 12, 5) * 2).astype(np.uint64) for _ in range(300)]
    y = np.asarray([min(3, int((row < 8).sum())) for row in rows], float)
    m = Q.OrdinalModel.fit(rows, y, least=0.5, fewest=1)
    assert (np.diff(m.thresholds) > 0).all() and len(m.thresholds) == len(np.unique(y)) - 1
    assert np.corrcoef(T.Sparse(rows, m.keys).dot(m.weights), y)[0, 1] > 0.8


def test_toxicity_on_held_out_rows(spark):
    docs, _, toxic = corpus(2, 1200)
    d = spark.createDataFrame([(*x, 0.5) for x in docs + EXTRA], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame(toxic + [(None, 1), (77, None)], "doc_id long, toxic int")
    got = X.toxicity_scores(d, labels).collect()
    truth = dict(toxic)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(got) == len(docs) + len(EXTRA) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted and not truth[r.doc_id] for r in held) == 0
    assert sum(r.predicted for r in held) >= 0.97 * sum(truth[r.doc_id] for r in held)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {(r.doc_id, r.score) for r in X.toxicity_scores(d, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}  # held-out labels teach nothing
    assert X.toxicity_scores(d.limit(0), labels).collect() == []
    assert all(r.predicted == 0 for r in X.toxicity_scores(d, labels.limit(0)).collect())


def test_swaps_keep_group_terms_neutral():
    """Insults in the labels always come with one group; naming the group alone must not score."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    texts, y = [], []
    for _ in range(1500):
        w = [r.choice(words) for _ in range(12)]
        bad = r.random() < 0.2
        if bad:
            w += ["Muslims"] if r.random() < 0.9 else []
            w += ["blorg"] if r.random() < 0.7 else []
        elif r.random() < 0.1:
            w += ["Christians"]
        texts.append(" ".join(w))
        y.append(bad)
    import pyarrow as pa

    h, b = T.document_features(pa.array(texts), False)
    rows = [h[i:j] for i, j in zip(b, b[1:])]
    fair = X.CounterfactualModel.fit(rows, np.asarray(y), penalty=200.0)
    plain = X.CounterfactualModel.fit(rows, np.asarray(y), penalty=0.0)
    probe = pa.array(["w1 w2 muslims w3", "w1 w2 christians w3", "w1 blorg w2"])
    (f, moved), (p, moved_plain) = fair.scores(probe), plain.scores(probe)
    assert abs(moved[:2]).max() < 0.1 * abs(moved_plain[:2]).max() and moved[2] == moved_plain[2] == 0
    # Held-out rows that name a group: the mean change of their scores under swaps.
    held = pa.array([f"{t} {g}" for t in texts[:200] for g in ("muslims", "jews", "atheists")])
    assert np.abs(fair.scores(held)[1]).mean() < 0.1 * np.abs(plain.scores(held)[1]).mean()
    assert p[0] - p[1] > 0.5 and abs(f[0] - f[1]) < 0.15 and f[2] > 0.5


def test_sample_is_bounded_and_whole(spark):
    d = spark.createDataFrame([(k, f"t{k}") for k in range(50)] + [(7, "zz")] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(7, 0)] * 9, "doc_id long, q int")
    s = T.labelled_sample(d, labels, "q", id_col="doc_id", text_col="text", most=20).collect()
    assert len(s) == 20
    all_ = T.labelled_sample(d, labels, "q", id_col="doc_id", text_col="text", most=500).collect()
    assert len(all_) == 50 and {r.text: r.y for r in all_}["t7"] == 1.0
    assert T.telling([], np.zeros(0), 1, 1, 5).tolist() == []


@pytest.mark.parametrize("texts", [[], [""], [None, "A a a"]])
def test_features_of_little(texts):
    import pyarrow as pa

    for shapes in (False, True):
        h, b = T.document_features(pa.array(texts, pa.string()), shapes)
        assert len(b) == len(texts) + 1 and b[-1] == len(h)
