"""Altered images against plain Python, a pixel at a time."""

import colorsys
import math
from statistics import NormalDist

import numpy as np
import pytest

from lodequery import queries as Q
from lodequery.sources import augment as A

HOW = A.Amounts(global_scale=(0.5, 1.5), hls_cells=(2, 3), hls_factors=(1, 0.5), space_cells=(2,), space_factors=(1,))


def perlin(angles, y, x):
    a, b = len(angles) - 1, len(angles[0]) - 1
    i, j = min(int(y), a - 1), min(int(x), b - 1)
    smooth = lambda t: 6 * t**5 - 15 * t**4 + 10 * t**3
    total = 0.0
    for di in (0, 1):
        for dj in (0, 1):
            t = angles[i + di][j + dj]
            share = (smooth(y - i) if di else 1 - smooth(y - i)) * (smooth(x - j) if dj else 1 - smooth(x - j))
            total += share * (math.sin(t) * (y - i - di) + math.cos(t) * (x - j - dj))
    return total


def plain(image, h, w, key, seed):
    """image[channel][i][j]; the draws come in the order: scale, shifts, HLS lattices, angle, space lattices."""
    g, n = np.random.default_rng([seed, key]), NormalDist()
    scale, shift = g.uniform(0.5, 1.5), [g.uniform(*r) for r in HOW.hls_shift]
    lattices = lambda layers, cells: [g.uniform(0, 2 * np.pi, (layers, c + 1, c + 1)) for c in cells]
    hls, angle = lattices(3, HOW.hls_cells), g.uniform(*HOW.angle) * scale
    space = lattices(2, HOW.space_cells)
    at = lambda some, factors, layer, i, j: sum(f * perlin(t[layer], (i + 0.5) / h * (len(t[layer]) - 1), (j + 0.5) / w * (len(t[layer]) - 1)) for t, f in zip(some, factors))
    toned = {}
    for i in range(h):
        for j in range(w):
            moved = [scale * (HOW.hls_scale[c] * at(hls, HOW.hls_factors, c, i, j) + shift[c]) for c in range(3)]
            hue, *ls = colorsys.rgb_to_hls(*[image[c][i][j] for c in range(3)])
            ls = [n.cdf(n.inv_cdf(min(max(v, 1e-12), 1 - 1e-12)) + 2 * m) for v, m in zip(ls, moved[1:])]
            toned[i, j] = colorsys.hls_to_rgb((hue + moved[0]) % 1, *ls)
    out = np.zeros((3, h, w))
    for i in range(h):
        for j in range(w):
            x, y = (2 * j + 1) / w - 1, (2 * i + 1) / h - 1
            bend = [HOW.space_scale * scale * at(space, HOW.space_factors, c, i, j) for c in (0, 1)]
            px = ((x * math.cos(angle) - y * math.sin(angle) + bend[0] + 1) * w - 1) / 2
            py = ((x * math.sin(angle) + y * math.cos(angle) + bend[1] + 1) * h - 1) / 2
            for a in (math.floor(py), math.floor(py) + 1):
                for b in (math.floor(px), math.floor(px) + 1):
                    share = (1 - abs(py - a)) * (1 - abs(px - b))
                    out[:, i, j] += share * np.asarray(toned.get((a, b), (0, 0, 0)))
    return out


def test_altered_images_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 40)
    r = np.random.default_rng(1)
    shapes = [(4, 5), (4, 5), (3, 3), (4, 5), (1, 6)]
    rows = [(k - 2, h, w, *r.uniform(size=(3, h * w)).tolist()) for k, (h, w) in enumerate(shapes)]
    rows += [rows[0], (None, *rows[2][1:]), (7, 2, 2, [0.0] * 4, [1.0] * 4, [0.5] * 4)]
    bad = [(20, 2, 2, None, [0.1] * 4, [0.1] * 4), (21, 2, 2, [0.1] * 3, [0.1] * 4, [0.1] * 4), (22, None, 2, [0.1] * 4, [0.1] * 4, [0.1] * 4), (23, 2, 2, [0.1, None, 0.1, 0.1], [0.1] * 4, [0.1] * 4), (24, 0, 0, [], [], [])]
    df = spark.createDataFrame(rows + bad, "id long, h int, w int, r array<double>, g array<double>, b array<double>")
    got = A.altered_images(df.repartition(3), seed=5, how=HOW).collect()
    assert len(got) == len(rows) + len(bad)
    for key, h, w, *image in rows:
        own = [x for x in got if x.id == key and (x.h, x.w) == (h, w)]
        want = plain(np.reshape(image, (3, h, w)), h, w, (-1 if key is None else key) & (1 << 64) - 1, 5)
        for x in own:
            np.testing.assert_allclose(np.reshape([x.r, x.g, x.b], (3, h, w)), want, atol=1e-9)
        assert len(own) == (2 if key == -2 else 1)
    assert all(x.r is x.g is x.b is None for x in got if (x.id or 0) >= 20)
    assert A.altered_images(df.limit(0)).collect() == []


def test_squeeze_and_colours():
    assert A.squeeze(0.0, [0.2, 0.9]) == pytest.approx([0.2, 0.9])
    assert A.squeeze(0.5, 0.5) == pytest.approx(NormalDist().cdf(1.0))
    x = np.random.default_rng(2).uniform(size=(5, 3, 4, 4))
    x[0], x[1, :2], x[2, 0] = 0.25, 1.0, 0.0
    np.testing.assert_allclose(A.hls_to_rgb(A.rgb_to_hls(x)), x, atol=1e-9)
    still = A.Amounts(global_scale=(0.0, 0.0))
    np.testing.assert_allclose(A.altered(x, list(range(5)), 0, still), x, atol=1e-9)


def test_every_vector_is_an_image(spark, tmp_path):
    rows = [(k, k % 2, [math.sin(k + i) / 4 for i in range(64)]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.QUERIES["altered_images"](spark, str(tmp_path)).collect()
    assert sorted(x.vec_id for x in got) == list(range(40)) and all(len(c) == 64 and 0 <= min(c) <= max(c) <= 1 for x in got for c in (x.r, x.g, x.b))
