import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodequery.llm import kneser_ney as K
from lodequery.llm import store


def corpus():
    r = random.Random(8)
    words = ["The", "the", "a", "b,", "cé", "dd", "e"] + [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(r.choice(words[: r.choice([5, 47])]) for _ in range(r.randrange(0, 80)))) for k in range(150)]
    return docs + [(None, "the a the b,"), (200, None), (201, ""), (202, " \n"), (5, "the the the the zz"), (5, "the the the the zz"), (203, "unknown things " * 300)]


def brute(docs, order=2):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    grams = lambda w, m: zip(*[(["<s>"] * (m - 1) + w)[k:] for k in range(m)])
    c, levels = Counter(), {order: Counter()}
    for (_, t), h in zip(docs, held):
        if not h:
            w = tok(t)
            c.update(w)
            levels[order].update(grams(w, order))
    n, v = sum(c.values()), len(c)
    for m in range(order - 1, 0, -1):  # each gram below counts the words that come before it
        levels[m] = Counter(g[1:] for g in levels[m + 1])

    def discounts(values):
        k = [sum(x == j for x in values) for j in (1, 2, 3, 4)]
        if min(k[:3]) <= 0:
            return [0, 0.75, 0.75, 0.75]
        y = k[0] / (k[0] + 2 * k[1])
        return [0] + [min(max(j - (j + 1) * y * k[j] / k[j - 1], 0), j) for j in (1, 2, 3)]

    d = {m: discounts(x.values()) for m, x in levels.items()}
    after = {m: defaultdict(list) for m in levels}
    for m, x in levels.items():
        for g, k in x.items():
            after[m][g[:-1]].append(k)

    def p(context, w):
        if context is None:
            return 1 / (v + 1)
        m = len(context) + 1
        below = p(context[1:] if context else None, w)
        if not (have := after[m].get(context)):
            return below
        x = levels[m][(*context, w)]
        return (max(x - d[m][min(x, 3)], 0) + sum(d[m][min(y, 3)] for y in have) * below) / sum(have)

    for context in list(after[order])[:5]:
        assert math.isclose(sum(p(context, w) for w in c) + p(context, "never seen"), 1)
    out = []
    for (i, text), h in zip(docs, held):
        w = tok(text)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(g[:-1], g[-1])) for g in grams(w, order))))
    return out


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders_against_brute_force(spark, order):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, K.language_model_scores(d, order=order).collect()), key=lambda r: str(r[:3]))
    for g, w in zip(got, sorted(brute(docs, order), key=lambda r: str(r[:3])), strict=True):
        assert g[:5] == w[:5] and g[6] == pytest.approx(w[6], abs=1e-9)
    assert K.language_model_scores(d.limit(0), order=order).collect() == []
    with pytest.raises(ValueError):
        K.KneserNey.fit(d, order=1)


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(K, "COUNT_BYTES", 500)
        monkeypatch.setattr(K, "SCORE_BYTES", 300)
    docs = corpus()
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, score string").repartition(3)
    got = sorted(map(tuple, K.language_model_scores(d).collect()), key=lambda r: str(r[:3]))
    want = sorted(brute(docs), key=lambda r: str(r[:3]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1e-9)
    assert K.language_model_scores(d.limit(0)).collect() == []
    only_held = K.language_model_scores(d.where("crc32(cast(doc_id as string)) % 5 = 1")).collect()
    assert only_held and all(r.held_out and r.score == r.base_score == 0 for r in only_held)


def test_a_missing_shard_is_an_error(spark):
    d = spark.createDataFrame([(k, f"some words {k} and more") for k in range(40)], "doc_id long, text string")
    for kind in ("grams-2", "lexicon"):
        model = K.KneserNey.fit(d)
        assert model.written[kind].sum() > 3 and model.score(d, ["doc_id"]).count() == 40
        shard = int(np.flatnonzero(model.written[kind])[1])
        os.remove(store._resolve(f"{model.folder}/{kind}/{shard}.pack")[1])
        with pytest.raises(Exception, match=f"{shard}.pack"):
            model.score(d, ["doc_id"]).collect()


def test_shards_follow_the_corpus(spark):
    d = spark.createDataFrame([(k, f"some words {k} and more") for k in range(400)], "doc_id long, text string")
    few, many = K.KneserNey.fit(d), K.KneserNey.fit(d, shard_bytes=20)
    assert few.bits == 3 and many.bits == 9
    rows = [sorted((r.doc_id, round(r.score, 9)) for r in m.score(d, ["doc_id"]).collect()) for m in (few, many)]
    assert rows[0] == rows[1]


def test_many_counts_and_bucketed_search(spark):
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = K._buckets(keys, 0)
        assert (K.find(keys, b, 0, keys) == np.arange(len(keys))).all()
        assert (K.find(keys, b, 0, keys + np.uint64(1)) == -1).all()
    x = np.array([0, 1, 255, 256, 2**40], np.uint64)
    assert (K._unsmall(K._small(x)) == x).all()


@pytest.mark.parametrize("order", [2, 3])
def test_look_ups_by_shard_give_the_same(spark, monkeypatch, order):
    """64 shards of each kind, of which a task may map two: grams are sent to the files."""
    monkeypatch.setattr(K, "SCORE_BYTES", 300)
    monkeypatch.setattr(K, "MOST_ROUTES", 16)  # four shards a way
    docs = corpus()
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, score string").repartition(3)
    size = sum(len((t or "").encode()) for _, t in docs)
    model = K.KneserNey.fit(d, order=order, shard_bytes=size // 40)
    assert model.bits == 6 and model.files > 64
    plain, sent = (sorted(map(tuple, model.score(d, ["doc_id"], most_maps=n).collect()), key=str) for n in (4096, 2))
    assert plain == sent and len(plain) == len(docs)
    assert model.score(d.limit(0), ["doc_id"], most_maps=2).collect() == []
    got = sorted(map(tuple, K.language_model_scores(d, order=order, most_maps=2).collect()), key=lambda r: str(r[:3]))
    for g, w in zip(got, sorted(brute(docs, order), key=lambda r: str(r[:3])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1e-9)


def test_a_missing_shard_is_an_error_when_grams_are_sent(spark):
    d = spark.createDataFrame([(k, f"some words {k} and more") for k in range(40)], "doc_id long, text string")
    model = K.KneserNey.fit(d)
    shard = int(np.flatnonzero(model.written["grams-2"])[1])
    os.remove(store._resolve(f"{model.folder}/grams-2/{shard}.pack")[1])
    with pytest.raises(Exception, match=f"{shard}.pack"):
        model.score(d, ["doc_id"], most_maps=2).collect()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_root(Session)
