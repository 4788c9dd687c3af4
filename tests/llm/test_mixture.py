import hashlib
import math
import random

import duckdb
import pytest

from lodequery.llm import mixture as M


def rows_of(seed=0):
    r = random.Random(seed)
    docs = []
    for k in range(400):
        source = r.choices(["a", "b", "c", None, "empty"], [60, 20, 5, 3, 1])[0]
        docs.append((k, "" if source == "empty" else " ".join("w" for _ in range(r.randrange(0, 30))), source))
    return docs + [(None, "x y z", "a"), (7, None, "b"), (8, "one two", "c"), (8, "one two", "c")]


def brute(docs, seed=7, block_tokens=1 << 20, budget=None, **o):
    names = sorted({s for *_, s in docs}, key=lambda s: (s is not None, s or ""))
    n = [len((t or "").split()) for _, t, _ in docs]
    have = [sum(x for x, d in zip(n, docs) if d[2] == s) for s in names]
    ppm = M.weights_ppm([h / sum(have) for h in have], **o, times=budget / sum(have) if budget else None)
    limit = o.get("repeat_limit", 4.0) if budget else math.inf
    budget = budget or max(-(-h * 10**6 // w) for h, w in zip(have, ppm) if w)
    blocks = max(1, -(-budget // block_tokens))
    out = []
    for s, a, w in zip(names, have, ppm):
        quota = int(min(w * budget // 10**6, limit * a))
        for epoch in range(max(1, -(-quota // a)) if a else 1):
            own = [(hashlib.md5(":".join([str(d[0]) if d[0] is not None else "", str(epoch), str(seed)]).encode()).hexdigest(), hashlib.md5((d[1] or "").encode()).hexdigest(), d[0], x) for d, x in zip(docs, n) if d[2] == s]
            start = epoch * a
            for draw, _, i, x in sorted(own, key=lambda v: v[:2]):
                if start < quota or (epoch == 0 and (a == 0 or x == 0)):
                    out.append((i, s, epoch, min(blocks - 1, start * blocks // quota if quota else 0), draw, x))
                start += x
    return sorted(out, key=str), budget, ppm


@pytest.mark.parametrize("options", [{}, {"block_tokens": 500}, {"budget": 3000, "block_tokens": 250}, {"target_entropy": 1.0, "repeat_limit": 2.0}, {"slices": 1}])
def test_mixture_against_brute_force(spark, options):
    docs = rows_of()
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, source string, epoch int").repartition(3)
    got = sorted(map(tuple, M.mix_sources(d, **options).collect()), key=str)
    want, budget, ppm = brute(docs, **{k: v for k, v in options.items() if k != "slices"})
    assert got == want
    if "budget" not in options:
        assert {r[0] for r in got} == {x[0] for x in docs}  # every document is drawn
    drawn = {}
    for _, s, *_, n in got:
        drawn[s] = drawn.get(s, 0) + n
    names = sorted({s for *_, s in docs}, key=lambda s: (s is not None, s or ""))
    for s, w in zip(names, ppm):
        assert 0 <= drawn[s] - w * budget // 10**6 < 30 or not w
    assert M.mix_sources(d.limit(0)).collect() == []


def test_documents_come_as_often_as_drawn(spark):
    docs = [(k, f"{t} {k}" if t else t, s) for k, t, s in rows_of(5)]
    d = spark.createDataFrame([(*x, 9, 8, "z") for x in docs], "doc_id long, text string, source string, a int, epoch int, `x.y` string").repartition(3)
    for options in ({}, {"budget": 2500}, {"block_tokens": 200}):
        want = M.mix_sources(d, **options).collect()
        mixed = M.mixed_documents(d, **options)
        assert mixed.columns == d.columns
        got = mixed.collect()
        assert sorted(str((r.doc_id, r.source, r.n_tokens)) for r in want) == sorted(str((r.doc_id, r.source, len((r.text or "").split()))) for r in got)
        # Each source's tokens are spread over the whole of the mixture.
        half = got[: len(got) // 2]
        for s in "ab":
            share = sum(r.source == s for r in half) / sum(r.source == s for r in got)
            assert "block_tokens" not in options or 0.3 < share < 0.7
    block = {}
    for r in want:
        block.setdefault(str(r.doc_id), []).append(r.block)
    places = [k for k, r in enumerate(got) if len(block[str(r.doc_id)]) == 1]
    order = [block[str(got[k].doc_id)][0] for k in places]
    assert max(order) > 20 and sum(abs(a - b) for a, b in zip(order, sorted(order))) <= 1.5 * len(order)  # a block away at most
    assert M.mixed_documents(d.limit(0)).collect() == []


def test_sql_gives_the_same(spark):
    docs = rows_of(3)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    want = con.execute(M.mixture_sql(block_tokens=500)).fetchall()
    names = ["doc_id", "source", "epoch", "block", "draw", "n_tokens"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in M.mix_sources(d, block_tokens=500).select(names).collect())


def test_exponent():
    shares = [0.7, 0.2, 0.06, 0.04]
    a = M.bisect_exponent(shares, target_entropy=0.9, repeat_limit=100)
    assert M.entropy(M.tempered(shares, a)) == pytest.approx(0.9 * math.log(4), abs=1e-6)
    b = M.bisect_exponent(shares, target_entropy=0.99, repeat_limit=3.0)
    assert (0.7 / 0.04) ** (1 - b) == pytest.approx(3.0)
    assert M.bisect_exponent([1.0]) == M.bisect_exponent([0.5, 0.5]) == 1.0 and M.weights_ppm([0.0, 0.0]) == [0, 0]


def test_repeat_limit_under_a_budget(spark):
    with pytest.raises(ValueError):
        M.bisect_exponent([0.9, 0.1], repeat_limit=4.0, times=20)
    docs = [(k, "w w w w w", "big" if k % 10 else "small") for k in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        M.mix_sources(d, budget=20 * 1000)
    for times, limit in ((20, 25.0), (3, 4.0), (0.5, 0.6), (20, 20.0)):
        budget = int(times * 1000)
        got = sorted(map(tuple, M.mix_sources(d, budget=budget, repeat_limit=limit).collect()), key=str)
        assert got == brute(docs, budget=budget, repeat_limit=limit)[0]
        for s, tokens in (("big", 900), ("small", 100)):
            drawn = sum(r[5] for r in got if r[1] == s)
            assert drawn <= limit * tokens + 5 and drawn > 0  # the last document may go over
        a = M.bisect_exponent([0.9, 0.1], repeat_limit=limit, times=times)
        free = M.bisect_exponent([0.9, 0.1], repeat_limit=1e9)
        assert a >= free and (a == free or max(w / s for w, s in zip(M.tempered([0.9, 0.1], a), (0.9, 0.1))) * times == pytest.approx(limit, rel=1e-6) or times == limit)
