"""Binning of components to cells of a histogram. A binner is any callable from three columns to three columns of bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .colorspace import ColorSpace, component_ranges


class UIntBinner:
    """The high bits of whole numbers of `bits` bits; the number of bins is a power of two."""

    def __init__(self, bins: int = 32, bits: int = 8):
        if bins < 1 or bins & (bins - 1) or bins > 256:
            raise ValueError("bins are a power of two from 1 to 256")
        if bits not in (8, 16):
            raise ValueError("components have 8 or 16 bits")
        self.bins, self.shift = bins, bits - (bins.bit_length() - 1)

    def __call__(self, c0: Column, c1: Column, c2: Column) -> list[Column]:
        return [F.shiftright(c.cast("long"), self.shift).cast("int") for c in (c0, c1, c2)]


class FloatBinner:
    """Equal steps between bounds, in single precision; what is below or is no number goes to the first bin, what is above to the last."""

    def __init__(self, ranges: Sequence[tuple[float, float]], bins: int = 32):
        if not 1 <= bins <= 256:
            raise ValueError("bins are 1 to 256")
        self.bins = bins
        self.low = [np.float32(a) for a, _ in ranges]
        self.step = [np.float32(np.float32(np.float32(b) - np.float32(a)) / np.float32(bins)) for a, b in ranges]

    def __call__(self, c0: Column, c1: Column, c2: Column) -> list[Column]:
        out = []
        for c, low, step in zip((c0, c1, c2), self.low, self.step, strict=True):
            offset = (c.cast("float") - F.lit(float(low)).cast("float")).cast("float")
            x = (offset.cast("double") / F.lit(float(step))).cast("float").cast("double")
            out.append(F.floor(F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(self.bins - 1.0))).cast("int"))
        return out


def default_binner(space: str | ColorSpace, bins: int = 32) -> UIntBinner | FloatBinner:
    space = ColorSpace.of(space)
    return UIntBinner(bins) if space is ColorSpace.SRGB else FloatBinner(component_ranges(space), bins)
