"""Palettes by recursive variance-minimising cuts of a histogram.

Pixels are summed into cells by Catalyst; a histogram has bins^3 rows an image at most, and each image's boxes are then found in one group
function over those rows. Boxes are named in the order of their lower bounds. Of boxes with equal variance the one that was made first is cut
first. Sums are whole numbers (of steps, for fractional components), so that results do not depend on how rows are dealt.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import UIntBinner
from ..types import MAX_PIXELS, AboveMaxLen, PaletteSize
from . import histogram

BOXES = "image_id long, palette_idx int, lo0 int, hi0 int, lo1 int, hi1 int, lo2 int, hi2 int, n long, s0 double, s1 double, s2 double"
#: Cells of at most 8 images of 32^3 bins: tables up to this many rows may be broadcast.
BROADCAST_ROWS = 1 << 18


class Grid:
    """Running sums over a histogram, so that a box's sums are eight look-ups."""

    def __init__(self, bins: Sequence[np.ndarray], values: Sequence[np.ndarray], size: int, scale: int = 1):
        self.size, self.scale = size, scale
        self.total = []
        for v in values:
            cube = np.zeros((size + 1,) * 3, v.dtype)
            np.add.at(cube, tuple(b + 1 for b in bins), v)
            for axis in range(3):
                np.cumsum(cube, axis=axis, out=cube)
            self.total.append(cube)

    def sums(self, box) -> list:
        (a, b), (c, d), (e, f) = box
        return [t[b, d, f] - t[a, d, f] - t[b, c, f] - t[b, d, e] + t[a, c, f] + t[a, d, e] + t[b, c, e] - t[a, c, e] for t in self.total]

    def variance(self, box) -> float:
        if histogram.is_single_bin(box):
            return 0.0
        n, *s, ss = self.sums(box)
        return float(ss) / self.scale - sum((float(x) / self.scale) ** 2 for x in s) / float(n) if n else 0.0

    def slabs(self, box, axis: int) -> list[np.ndarray]:
        """Sums of the box from its lower bound to each place inside it, along an axis."""
        lo, hi = box[axis]
        (c, d), (e, f) = (x for i, x in enumerate(box) if i != axis)
        out = []
        for t in self.total[:4]:
            t = np.moveaxis(t, axis, 0)[lo:hi]
            plane = t[:, d, f] - t[:, c, f] - t[:, d, e] + t[:, c, e]
            out.append(plane[1:] - plane[0])
        return out

    def cut(self, box):
        """The two halves, or None."""
        n, *s, _ = self.sums(box)
        best = None
        for axis in range(3):
            nu, *su = self.slabs(box, axis)
            nl = n - nu
            ok = np.flatnonzero((nu > 0) & (nl > 0))
            if not len(ok):
                continue
            up = sum(x[ok].astype(float) ** 2 for x in su) / nu[ok]
            low = sum((t - x[ok]).astype(float) ** 2 for t, x in zip(s, su, strict=True)) / nl[ok]
            score = -(up + low)
            i = int(np.argmin(score))
            if best is None or score[i] < best[0]:
                best = (score[i], axis, box[axis][0] + 1 + int(ok[i]))
        if best is None:
            return None
        _, axis, at = best
        halves = []
        for lo, hi in ((box[axis][0], at), (at, box[axis][1])):
            halves.append(tuple((lo, hi) if i == axis else x for i, x in enumerate(box)))
        return halves

    def boxes(self, k: int) -> list:
        made = 1
        queue = [(-float("inf"), 0, ((0, self.size),) * 3)]
        while 0 < len(queue) < k and queue[0][0] < 0:
            _, age, box = heapq.heappop(queue)
            halves = self.cut(box)
            if halves is None:
                heapq.heappush(queue, (0.0, age, box))
                continue
            for half in halves:
                heapq.heappush(queue, (-self.variance(half), made, half))
                made += 1
        return sorted(b for _, _, b in queue)


def find_boxes(cells: DataFrame, k: int | PaletteSize, bins: int, scale: int = 1) -> DataFrame:
    """The boxes of each image, with their sums, in units of the components. Fewer than k where there is nothing more to cut."""
    size = int(PaletteSize.of(k))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["n"].sum() > MAX_PIXELS:
            raise AboveMaxLen(MAX_PIXELS)
        grid = Grid([pdf[f"b{i}"].to_numpy() for i in range(3)], [pdf["n"].to_numpy(np.int64), *(pdf[f"s{i}"].to_numpy(np.int64) for i in range(3)), pdf["ss"].to_numpy(np.int64 if scale > 1 else np.float64)], bins, scale)
        rows = []
        for i, box in enumerate(grid.boxes(size)):
            n, *s, _ = grid.sums(box)
            rows.append((pdf["image_id"].iloc[0], i, *(x for pair in box for x in pair), int(n), *(float(x) / scale for x in s)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BOXES.split(", ")])

    if not size:
        return cells.sparkSession.createDataFrame([], BOXES)
    return cells.groupBy("image_id").applyInPandas(search, BOXES)


def palette_of(boxes: DataFrame, whole: bool = True) -> DataFrame:
    """(image_id, palette_idx, c0, c1, c2, n): the boxes' mean colours. Means of whole components are cut to whole numbers."""
    means = [(F.floor(F.col(f"s{i}") / F.col("n")).cast("double") if whole else (F.col(f"s{i}") / F.col("n")).cast("float").cast("double")).alias(f"c{i}") for i in range(3)]
    return boxes.where("n > 0").select("image_id", "palette_idx", *means, "n")


def cell_lookup(boxes: DataFrame, occupied: DataFrame) -> DataFrame:
    """(image_id, b0, b1, b2, palette_idx) of occupied cells. An image has 256 boxes and bins^3 cells at most."""
    b = boxes.select("image_id", "palette_idx", *[f"{x}{i}" for i in range(3) for x in ("lo", "hi")])
    cells = occupied.select("image_id", "b0", "b1", "b2")
    every = b
    for i in range(3):
        every = every.withColumn(f"b{i}", F.explode(F.sequence(F.col(f"lo{i}"), F.col(f"hi{i}") - 1)))
    return cells.join(every.select("image_id", "b0", "b1", "b2", "palette_idx"), ["image_id", "b0", "b1", "b2"])


def lookup(colors: DataFrame, boxes: DataFrame, binner: Callable[..., Sequence[Column]], components: Sequence[str] = ("r", "g", "b"), occupied: DataFrame | None = None) -> DataFrame:
    """The colours (or pixels) with the palette_idx of their cell's box."""
    binned = colors.withColumns({f"b{i}": b for i, b in enumerate(binner(*map(F.col, components)))})
    cells = cell_lookup(boxes, binned.select("image_id", "b0", "b1", "b2").distinct() if occupied is None else occupied)
    return binned.join(cells, ["image_id", "b0", "b1", "b2"]).drop("b0", "b1", "b2")


def palette(colors: DataFrame, k: int | PaletteSize = 256, binner: UIntBinner | Callable = UIntBinner(), components: Sequence[str] = ("r", "g", "b"), scale: int = 1, bins: int | None = None) -> DataFrame:
    return palette_of(find_boxes(histogram.moments(colors, binner, components, scale), k, bins or binner.bins, scale), scale == 1)


def indexed_palette(colors: DataFrame, k: int | PaletteSize = 256, binner: UIntBinner | Callable = UIntBinner(), components: Sequence[str] = ("r", "g", "b"), scale: int = 1, bins: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(palette, colours with palette_idx)."""
    cells = histogram.moments(colors, binner, components, scale)
    boxes = find_boxes(cells, k, bins or binner.bins, scale)
    return palette_of(boxes, scale == 1), lookup(colors, boxes, binner, components, cells)
