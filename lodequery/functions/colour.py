"""RGB and HLS, both in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    c = hi - lo
    turn = F.when(hi == r, F.try_divide(g - b, c)).when(hi == g, F.try_divide(b - r, c) + 2).otherwise(F.try_divide(r - g, c) + 4)
    light = (hi + lo) / 2
    h = F.when(c == 0, 0.0).otherwise(F.pmod(turn / 6, F.lit(1.0)))
    return h, light, F.when(c == 0, 0.0).otherwise(F.try_divide(c, 1 - F.abs(2 * light - 1)))


def hls_to_rgb(h: Column, l: Column, s: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    a = s * F.least(l, 1 - l)

    def channel(n: int) -> Column:
        k = F.pmod(n + 12 * h, F.lit(12.0))
        return F.least(F.greatest(l - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))), F.lit(0.0)), F.lit(1.0))

    return channel(0), channel(8), channel(4)
