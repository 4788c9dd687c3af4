import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodequery.llm import qualityrules as Q


def plain_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    telling = lambda c: bool(re.fullmatch(r"[0-9A-Za-z]|[^\x00-\x7F]", c))
    seen, dup = set(), 0
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeat = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    ends = sum(telling(w[-1]) or (w[-1] in ".,;:!?'\")" and len(w) > 1 and telling(w[-2])) for w in words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(repeat), "n_lines": len(lines),
        "n_telling_words": sum(any(map(telling, w)) for w in words), "n_upper": sum("A" <= c <= "Z" for c in text), "n_lower": sum("a" <= c <= "z" for c in text),
        "n_shouts": sum(w.endswith("!!") for w in words), "n_plain_ends": ends, "n_doubled": sum(a == b for a, b in zip(words, words[1:])),
    }


def corpus(seed=3, n=500):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiéü") for _ in range(r.randrange(2, 9))) for _ in range(600)]
    out, good = [], {}
    for k in range(n):
        kind = r.choice(["good"] * 20 + ["caps", "marks", "bars", "doubled", "again"])
        w = [r.choice(vocabulary) + r.choice(["", "", "", ",", "."]) for _ in range(r.randrange(12, 150))]
        if kind == "caps":
            w = [x.upper() + "!!" for x in w]
        elif kind == "marks":
            w = [x + r.choice(["###", "%%%", "$$$"]) for x in w]
        elif kind == "bars":
            w = [y for x in w for y in (x, "|")]
        elif kind == "doubled":
            w = [y for x in w for y in (x, x)]
        elif kind == "again":
            w = w + w
        out.append((k, "".join(x + r.choice([" ", " ", " ", "\n", "  \t"]) for x in w)))
        good[k] = kind
    return out, good


ODD = [(None, "a b c"), (9000, None), (9001, ""), (9002, " \n\n \t"), (9003, "A b\nA b\n\nA b\r\n" * 3), (9004, "x " * 3000), (9005, "日本 語 \x00 \x85"), (9006, "one two three four five " * 2), (9001, ""), (9004, "x " * 3000)]


def test_signals_against_plain_python():
    texts = [t for _, t in corpus(5, 60)[0] + ODD]
    got = Q.signals(pa.array(texts, pa.string()))
    assert set(got) == set(Q.SIGNALS)
    for k, t in enumerate(texts):
        assert {s: int(got[s][k]) for s in Q.SIGNALS} == plain_signals(t), t
    assert all(len(v) == 0 for v in Q.signals(pa.array([], pa.string())).values())


def plain_votes(s):
    """The rules again, in Python."""
    n = s["n_words"]
    pairs = [
        (n < 10, n >= 30), (100 * s["n_repeat_words"] > 20 * n, n >= 10 and 100 * s["n_repeat_words"] <= 5 * n), (n >= 10 and 100 * s["n_doubled"] > 15 * n, n >= 10 and 100 * s["n_doubled"] <= 3 * n),
        (s["n_lines"] >= 4 and 100 * s["n_dup_lines"] > 30 * s["n_lines"], s["n_lines"] >= 2 and s["n_dup_lines"] == 0), (100 * s["n_symbols"] > 5 * s["word_chars"], n > 0 and 100 * s["n_symbols"] <= s["word_chars"]),
        (n >= 5 and not 2 * n <= s["word_chars"] <= 20 * n, n > 0 and 3 * n <= s["word_chars"] <= 12 * n), (n >= 5 and 100 * s["n_telling_words"] < 80 * n, n >= 5 and 100 * s["n_telling_words"] >= 95 * n),
        (n >= 5 and 100 * s["n_plain_ends"] < 75 * n, n >= 5 and 100 * s["n_plain_ends"] >= 95 * n),
        (s["n_upper"] + s["n_lower"] >= 20 and 100 * s["n_upper"] > 40 * (s["n_upper"] + s["n_lower"]), s["n_upper"] + s["n_lower"] >= 20 and 100 * s["n_upper"] <= 20 * (s["n_upper"] + s["n_lower"])),
        (n >= 5 and 100 * s["n_shouts"] > 20 * n, n >= 5 and 100 * s["n_shouts"] <= 2 * n),
    ]
    return [-1 if bad else int(good) for bad, good in pairs]


def plain_posteriors(table, steps=500):
    """Expectation-maximisation text by text."""
    m = len(table[0])
    share, a, b = 0.5, [0.999] * m, [0.3] * m
    for _ in range(steps + 1):
        p = []
        for v in table:
            good, bad = share, 1 - share
            for x, g, h in zip(v, a, b):
                good *= {1: g, -1: 1 - g, 0: 1}[x]
                bad *= {1: 1 - h, -1: h, 0: 1}[x]
            p.append(good / (good + bad))
        before = [share, *a, *b]
        new = (sum(p) + 5) / (len(p) + 10)
        a2, b2 = [], []
        for j in range(m):
            voted = [(q, v[j]) for q, v in zip(p, table) if v[j]]
            g = min(1 - 1e-6, max(0.5, (sum(q for q, x in voted if x == 1) + 9.99) / (sum(q for q, _ in voted) + 10)))
            a2.append(g)
            b2.append(min(1 - 1e-6, max(1 - g, (sum(1 - q for q, x in voted if x == -1) + 3) / (sum(1 - q for q, _ in voted) + 10))))
        if max(abs(x - y) for x, y in zip(before, [new, *a2, *b2])) < 1e-12:
            break
        share, a, b = new, a2, b2
    return p


def test_verdicts_against_brute_force(spark):
    rows, good = corpus()
    rows = rows + ODD
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, n_words int, kept string").repartition(5)
    got = Q.quality_rules(docs).collect()
    want = []
    plain = [plain_signals(t) for _, t in rows]
    for (i, _), s, p in zip(rows, plain, plain_posteriors([plain_votes(s) for s in plain])):
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        want.append((str(i), *(s[k] for k in Q.SIGNALS), failed, not failed and p >= 0.5, p))
    have = [(str(r.doc_id), *(r[k] for k in Q.SIGNALS), r.base_failed, r.kept, r.p_good) for r in got]
    for h, w in zip(sorted(have), sorted(want), strict=True):
        assert h[:-1] == w[:-1] and math.isclose(h[-1], w[-1], rel_tol=1e-4, abs_tol=1e-9)
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[k] for k, v in good.items() if v == "good")
    assert not any(verdict[k] for k, v in good.items() if v in ("caps", "marks", "bars", "again"))  # doubled words are told by one rule alone


def test_accuracies_are_found_without_labels():
    r = np.random.default_rng(1)
    truth = r.random(40_000) < 0.85
    right = np.array([0.97, 0.9, 0.99, 0.95, 0.98]), np.array([0.8, 0.7, 0.6, 0.9, 0.75])
    votes = np.where(r.random((len(truth), 5)) < np.where(truth[:, None], *right), 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[r.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = Q.estimate(patterns, counts)
    assert abs(got.share - 0.85) < 0.01 and np.abs(got.on_good - right[0]).max() < 0.01 and np.abs(got.on_bad - right[1]).max() < 0.04
    verdict = got.posterior(votes) >= 0.5
    all_must_pass = np.all(votes >= 0, axis=1)
    assert (verdict == truth).mean() > 0.97 > 0.9 > (all_must_pass == truth).mean()


def test_empty_table_and_given_accuracies(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").limit(0)
    assert Q.quality_rules(docs).collect() == []
    some = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven.")], "doc_id long, text string")
    n = len(Q.RULES)
    assert Q.quality_rules(some, accuracies=Q.Accuracies(0.5, np.full(n, 0.9), np.full(n, 0.9))).first().kept
    assert Q.quality_rules(some, accuracies=Q.Accuracies(0.01, np.full(n, 0.5), np.full(n, 0.5))).first().p_good == pytest.approx(0.01)
