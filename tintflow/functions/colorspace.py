"""sRGB, CIELAB (D65) and Oklab as expressions over columns, by the published formulas."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# IEC 61966-2-1's curve and primaries, the D65 white, and Oklab's two matrices.
SRGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LINEAR_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
# The ranges of components over all sRGB colours.
RANGES = {
    "srgb": ((0.0, 1.0), (0.0, 1.0), (0.0, 1.0)),
    "lab": ((0.0, 100.0), (-86.182686, 98.23433), (-107.86016, 94.477974)),
    "oklab": ((0.0, 1.0), (-0.2338874, 0.2762164), (-0.31152815, 0.19856972)),
}


class ColorSpace(Enum):
    SRGB = "srgb"
    LAB = "lab"
    OKLAB = "oklab"

    @classmethod
    def of(cls, value: str | ColorSpace) -> ColorSpace:
        return value if isinstance(value, cls) else cls(str(value).lower())


def component_ranges(space: str | ColorSpace) -> tuple[tuple[float, float], ...]:
    return RANGES[ColorSpace.of(space).value]


def _times(m, v: list[Column]) -> list[Column]:
    return [F.lit(float(a)) * v[0] + F.lit(float(b)) * v[1] + F.lit(float(c)) * v[2] for a, b, c in m]


def linear_table() -> list[float]:
    """The linear light of each of the 256 component values."""
    return [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in range(256)]


def from_srgb(r: Column, g: Column, b: Column, space: str | ColorSpace) -> list[Column]:
    """Components in the space, of components from 0 to 255. sRGB stays as it is."""
    space = ColorSpace.of(space)
    if space is ColorSpace.SRGB:
        return [r, g, b]
    table = F.array(*map(F.lit, linear_table()))
    v = [F.get(table, c.cast("int")) for c in (r, g, b)]
    if space is ColorSpace.OKLAB:
        return _times(LMS_TO_OKLAB, [F.cbrt(x) for x in _times(LINEAR_TO_LMS, v)])

    def f(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * ((29 / 6) ** 2 / 3) + 4 / 29)

    x, y, z = (f(c / F.lit(w)) for c, w in zip(_times(SRGB_TO_XYZ, v), WHITE, strict=True))
    return [y * 116 - 16, (x - y) * 500, (y - z) * 200]


def to_srgb(c0: Column, c1: Column, c2: Column, space: str | ColorSpace) -> list[Column]:
    """Components from 0 to 255, rounded and clamped."""
    space = ColorSpace.of(space)
    if space is ColorSpace.SRGB:
        return [F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("long") for c in (c0, c1, c2)]
    if space is ColorSpace.OKLAB:
        lms = [x * x * x for x in _times(np.linalg.inv(LMS_TO_OKLAB), [c0, c1, c2])]
        linear = _times(np.linalg.inv(LINEAR_TO_LMS), lms)
    else:
        y = (c0 + 16) / 116

        def back(t: Column) -> Column:
            return F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * (3 * (6 / 29) ** 2))

        linear = _times(np.linalg.inv(SRGB_TO_XYZ), [back(t) * F.lit(w) for t, w in zip((c1 / 500 + y, y, y - c2 / 200), WHITE, strict=True)])

    def curve(t: Column) -> Column:
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.floor(F.when(t <= 0.0031308, t * 12.92).otherwise(F.pow(t, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255 + 0.5).cast("long")

    return [curve(t) for t in linear]
