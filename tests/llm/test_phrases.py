import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lodequery.llm import phrase_index as P
from lodequery.llm import wordhash as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, it in items:
            x = words(it)
            n = min(window, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit |= set(range(p, p + n))
                        found |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_words_split_as_the_pattern():
    texts = ["Héllo wörld 12a,B", "", None, "  x", "x  ", "A\tb\x0bc\nd e\x1cf", "日本 語,z", "\x85a b", "Zz" * 5000]
    for table, pattern in ((W.ALNUM, WORD), (W.BLANK, re.compile(r"[^\x20\x09-\x0D]+"))):
        w = W.split(pa.array(texts), table)
        for k, t in enumerate(texts):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
            got = [w.data[a:b].tobytes().decode().lower() for a, b in zip(w.starts[w.bounds[k] : w.bounds[k + 1]], w.ends[w.bounds[k] : w.bounds[k + 1]])]
            assert [g.encode() for g in got] == [x.lower().encode() for x in pattern.findall(lower)]
    same = W.split(pa.array(["Abc abc x", "ABC"])).hashes
    assert same[0] == same[1] == same[3] != same[2]
    big = W.split(pa.array(["ab " * 900_000, "ab"])).hashes
    assert (big == big[0]).all()


def test_contamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "STEP", 5)
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c,", "dé", "e1"]) for _ in range(n))
    docs = [(k, text(rnd.randrange(0, 60))) for k in range(60)] + [(None, "a b c"), (5, None), (6, ""), (6, "a b c d"), (7, "one two"), (8, "a " * 3000)]
    items = [(k, text(rnd.choice([1, 2, 3, 5, 9]))) for k in range(25)] + [(None, "one two"), (30, None), (31, "..."), (3, "one two"), (3, "one two")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for window, size in ((4, 150), (10, 1 << 24)):
        got = P.contamination(d, i, window=window, segment_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items, window)
    assert P.contamination(d.limit(0), i).collect() == []
    assert {r.contaminated for r in P.contamination(d, i.limit(0)).collect()} == {False}


def test_near_matches(spark):
    d = spark.createDataFrame([(1, "x a y b z"), (2, "a q q q q b"), (3, "b a"), (4, "a"), (5, "b")], "doc_id long, text string")
    i = spark.createDataFrame([("p", "a b")], "item_id string, text string")
    index = P.build_index(d, segment_bytes=1 << 20)
    blocks = P.write_phrases(i, f"{index}/items")
    got = {tuple(r) for r in P.near_matches(spark, index, blocks, width=3).collect()}
    assert got == {(1, "p", 1, 3), (3, "p", 0, 1)}


def test_postings_fall_back_when_terms_share_high_bits():
    h = np.array([8, 9, 8, 1 << 60, 9], np.uint64)
    terms, begins, positions = P.postings(h)
    assert [positions[a:b].tolist() for a, b in zip(begins, begins[1:])] == [[0, 2], [1, 4], [3]] and terms.tolist() == [8, 9, 1 << 60]
