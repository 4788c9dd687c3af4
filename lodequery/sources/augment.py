"""Altered copies of images: fractal noise in HLS, rotation and distortion in space; by amounts drawn from each image's id.

An image is a row (id, h, w, r, g, b) with a flat array of h*w values in [0, 1] for each channel.  Everything
that is drawn depends on (seed, id) alone, so a copy is the same wherever and how often it is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels, or noise angles of an octave, that are worked on at once.
SLICE = 1 << 20
CHANNELS = ["r", "g", "b"]


@dataclass(frozen=True)
class Amounts:
    """How much is altered.  The defaults are fixed values of the data model."""

    global_scale: tuple[float, float] = (1.0, 1.0)  # factor of everything below, drawn for each image
    hls_cells: tuple[int, ...] = (2, 4, 8, 16, 32, 64, 128)  # noise cells along each axis, coarse to fine
    hls_factors: tuple[float, ...] = (1, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625)
    hls_shift: tuple[tuple[float, float], ...] = ((-0.1, 0.1), (-0.2, 0.2), (-0.2, 0.2))  # of the whole image, for each of H, L, S
    hls_scale: tuple[float, ...] = (0.5, 1.0, 1.0)
    space_cells: tuple[int, ...] = (2, 4, 8)
    space_factors: tuple[float, ...] = (1, 0.5, 0.25)
    space_scale: float = 0.2
    angle: tuple[float, float] = (-np.pi / 16, np.pi / 16)


def squeeze(mu, x) -> np.ndarray:
    """The normal share of x moved by 2 mu standard deviations and back to (0, 1)."""
    n, x = NormalDist(), np.clip(np.asarray(x, float), 1e-12, 1 - 1e-12)
    z = np.asarray(np.frompyfunc(n.inv_cdf, 1, 1)(x), float) + 2 * np.asarray(mu, float)
    return np.asarray(np.frompyfunc(n.cdf, 1, 1)(z), float)


def gradient_noise(angles: np.ndarray, h: int, w: int) -> np.ndarray:
    """Perlin noise on h x w pixel centres, from the gradients' angles at the cells' corners: (..., a + 1, b + 1) gives (..., h, w)."""
    a, b = angles.shape[-2] - 1, angles.shape[-1] - 1
    y, x = (np.arange(h) + 0.5) / h * a, (np.arange(w) + 0.5) / w * b
    i, j = np.minimum(y.astype(int), a - 1), np.minimum(x.astype(int), b - 1)
    v, u = (y - i)[:, None], (x - j)[None]
    fade = lambda t: t * t * t * (t * (6 * t - 15) + 10)

    def corner(di: int, dj: int) -> np.ndarray:
        t = angles[..., i + di, :][..., j + dj]
        return np.sin(t) * (v - di) + np.cos(t) * (u - dj)

    top = corner(0, 0) + fade(u) * (corner(0, 1) - corner(0, 0))
    low = corner(1, 0) + fade(u) * (corner(1, 1) - corner(1, 0))
    return top + fade(v) * (low - top)


def fractal_noise(rngs: list[np.random.Generator], layers: int, h: int, w: int, cells: tuple[int, ...], factors: tuple[float, ...]) -> np.ndarray:
    """(images, layers, h, w): octaves of gradient noise, each of its own cells and factor; a generator for each image."""
    out = np.zeros((len(rngs), layers, h, w))
    for n, f in zip(cells, factors):
        out += f * gradient_noise(np.stack([g.uniform(0, 2 * np.pi, (layers, n + 1, n + 1)) for g in rngs]), h, w)
    return out


def rgb_to_hls(x: np.ndarray) -> np.ndarray:
    """(..., 3, h, w) to hue, lightness and saturation along the same axis."""
    r, g, b = np.moveaxis(x, -3, 0)
    hi, lo = x.max(axis=-3), x.min(axis=-3)
    c, light = hi - lo, (hi + lo) / 2
    own = np.where(c > 0, c, 1)
    turn = np.select([hi == r, hi == g], [(g - b) / own, (b - r) / own + 2], (r - g) / own + 4)
    room = 1 - np.abs(2 * light - 1)
    return np.stack([turn / 6 % 1 * (c > 0), light, np.where(room > 0, c / np.where(room > 0, room, 1), 0)], axis=-3)


def hls_to_rgb(x: np.ndarray) -> np.ndarray:
    h, l, s = np.moveaxis(x, -3, 0)  # noqa: E741
    k = [(n + 12 * h) % 12 for n in (0, 8, 4)]
    a = s * np.minimum(l, 1 - l)
    return np.clip(np.stack([l - a * np.clip(np.minimum(t - 3, 9 - t), -1, 1) for t in k], axis=-3), 0, 1)


def sampled(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Images (n, 3, h, w) read at places (n, h, w, 2) of (across, down), -1 to 1 from edge to edge: bilinear, zero outside."""
    n, _, h, w = x.shape
    across, down = ((places[..., 0] + 1) * w - 1) / 2, ((places[..., 1] + 1) * h - 1) / 2
    j, i = np.floor(across).astype(int), np.floor(down).astype(int)
    own, out = np.arange(n)[:, None, None], np.zeros_like(x)
    for di in (0, 1):
        for dj in (0, 1):
            weight = np.abs(1 - di - (down - i)) * np.abs(1 - dj - (across - j))
            weight = weight * ((i + di >= 0) & (i + di < h) & (j + dj >= 0) & (j + dj < w))
            out += weight[:, None] * np.moveaxis(x[own, :, (i + di).clip(0, h - 1), (j + dj).clip(0, w - 1)], -1, 1)
    return out


def altered(x: np.ndarray, ids: list[int], seed: int, how: Amounts) -> np.ndarray:
    """Images (n, 3, h, w), first altered in HLS and then in space."""
    n, _, h, w = x.shape
    rngs = [np.random.default_rng([seed, i & (1 << 64) - 1]) for i in ids]
    one = lambda lo, hi: np.asarray([g.uniform(lo, hi) for g in rngs])[:, None, None]
    scale = one(*how.global_scale)
    shift = np.stack([one(*r) for r in how.hls_shift], axis=1)
    noise = fractal_noise(rngs, 3, h, w, how.hls_cells, how.hls_factors) * np.asarray(how.hls_scale)[:, None, None]
    noise = scale[:, None] * (noise + shift)
    hls = rgb_to_hls(x)
    x = hls_to_rgb(np.concatenate([(hls[:, :1] + noise[:, :1]) % 1, squeeze(noise[:, 1:], hls[:, 1:])], axis=1))
    turn = scale * one(*how.angle)
    bend = scale[..., None] * np.moveaxis(fractal_noise(rngs, 2, h, w, how.space_cells, how.space_factors), 1, -1)
    across, down = (2 * np.arange(w) + 1) / w - 1, ((2 * np.arange(h) + 1) / h - 1)[:, None]
    grid = np.stack([across * np.cos(turn) - down * np.sin(turn), across * np.sin(turn) + down * np.cos(turn)], axis=-1)
    return np.clip(sampled(x, grid + how.space_scale * bend), 0, 1)


def together(h: int, w: int, how: Amounts) -> int:
    """How many images are worked on at once: the noise of one has its angles to be drawn, however few its pixels."""
    angles = max([3 * (n + 1) ** 2 for n in how.hls_cells] + [2 * (n + 1) ** 2 for n in how.space_cells], default=0)
    return max(1, SLICE // max(h * w, angles))


def altered_images(df: DataFrame, seed: int = 0, how: Amounts = Amounts()) -> DataFrame:
    """(id, h, w, r, g, b): an altered copy of each image, a row for each row of df(id, h, w, r, g, b).

    Ids are whole numbers; rows of equal ids are altered alike, null ids as -1.  A row without size, or whose channels
    are null, hold a null, or aren't h*w long, gets null channels.
    """

    def alter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (h, w, ok), same in pdf.groupby(["h", "w", "ok"], dropna=False, sort=True):
                if not ok:
                    yield same.drop(columns="ok")
                    continue
                h, w = int(h), int(w)
                step = together(h, w, how)
                for k in range(0, len(same), step):
                    part = same.iloc[k : k + step]
                    x = np.stack([np.stack(part[c].tolist()) for c in CHANNELS], axis=1).reshape(len(part), 3, h, w)
                    x = altered(np.clip(x.astype(float), 0, 1), [-1 if pd.isna(i) else int(i) for i in part["id"]], seed, how).reshape(len(part), 3, h * w)
                    yield part.drop(columns="ok").assign(**{c: list(x[:, n]) for n, c in enumerate(CHANNELS)})

    size = F.col("h").cast("long") * F.col("w")
    fits = (F.col("h") > 0) & (F.col("w") > 0)
    for c in CHANNELS:
        fits = fits & (F.size(c) == size) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v))
    ok = F.coalesce(fits, F.lit(False))
    channels = [F.when(ok, F.col(c).cast("array<double>")).alias(c) for c in CHANNELS]
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), *channels, ok.alias("ok"))
    return rows.mapInPandas(alter, "id long, h int, w int, r array<double>, g array<double>, b array<double>")
