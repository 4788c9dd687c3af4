import hashlib
import math
import random

import numpy as np
import pytest

from lodequery.llm import vectorcodes as V


def brute(rows, parts, entries, rounds):
    ok = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in ok if r[2]), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not order:
        return []
    width = len(order[0][2])
    cut = lambda q: [q[p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    books = [list(b) for b in zip(*[cut(q) for _, _, q in [r for r in order if len(r[2]) == width][:entries]])]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    same = [r for r in ok if len(r[2]) == width]
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for r in same:
                own.setdefault(near(cut(r[2])[p], book)[1], []).append(cut(r[2])[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(book)]
    out, labels = [], {}
    for i, lab, q in ok:
        far = [near(x, b) for x, b in zip(cut(q), books)] if len(q) == width else None
        error = sum(d for d, _ in far) if far else None
        out.append((i, "".join(f"{k:02x}" for _, k in far) if far else None, error, lab))
        if far:
            labels[lab] = labels.get(lab, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, labels.get(lab), sha) for i, c, e, lab in out], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, label int, embedding array<double>, code string, error int")


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(V, "STEP", 100)
    r = random.Random(seed)
    some = lambda n=8: [r.gauss(0, 0.02) for _ in range(n)]
    hot = some()
    rows = [(k, r.choice([0, 0, 0, 1, 2, None]), hot if r.random() < 0.3 else some()) for k in range(300)]
    rows += [(None, 1, some()), (None, None, some()), (500, 1, None), (501, 1, [*some(7), None]), (502, 2, [*some(7), math.nan]), (503, 0, [*some(7), -math.inf]), (504, 9, some(4)), (505, 0, []), (3, 1, some()), (3, 1, some()), (7, None, hot), (7, None, hot)]
    r.shuffle(rows)
    got = V.vector_codes(frame(spark, rows).repartition(5), parts=4, entries=12, rounds=3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 12, 3)
    few = rows[:9]
    assert sorted(map(tuple, V.vector_codes(frame(spark, few), parts=2, entries=256, rounds=4).collect()), key=str) == brute(few, 2, 256, 4)


def test_tables_without_vectors(spark):
    empty = frame(spark, [(1, 1, [0.5, 0.5])]).limit(0)
    got = V.vector_codes(empty)
    assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    none = V.vector_codes(frame(spark, [(1, 1, None), (2, 1, []), (3, None, [])])).collect()
    assert sorted((x.vec_id, x.code, x.error, x.label_error) for x in none) == [(2, None, None, None), (3, None, None, None)]
    assert {x.codebooks_sha256 for x in none} == {hashlib.sha256(b"").hexdigest()}


def test_what_can_not_be_coded_is_refused(spark):
    with pytest.raises(ValueError):
        V.vector_codes(frame(spark, [(1, 1, [0.5] * 6)]), parts=4)
    with pytest.raises(OverflowError):
        V.nearest(np.array([[1 << 40, 0]]), np.array([[0, 1]]))
    with pytest.raises(OverflowError):
        V.Codebooks(np.zeros((1, 1, 1), np.int64)).sums(np.zeros((4, 1), np.int64), np.full((4, 1), 1 << 61))
    code, far = V.nearest(np.array([[1 << 29, 0]]), np.array([[0, 1], [1 << 29, 3], [1 << 29, -3]]))
    assert code.tolist() == [1] and far.tolist() == [9]  # the first of equal ones, with no rounding
