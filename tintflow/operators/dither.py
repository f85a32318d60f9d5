"""Error diffusion of palette indices, to the eye's advantage.

An image is walked row by row, each in the other direction than the row before; what a pixel's palette colour misses is handed on: 7/16 to the
next pixel, and 3/16, 5/16 and 1/16 to those below. That order is a chain through a whole band of rows, so an image is walked in bands; a band
after the first walks the last row of the band above once, only to gather what it would hand down. Bands of a task are walked side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearest import SENT_ROWS

DIFFUSION = 7 / 8


def checked_diffusion(value: float | None, default: float | None = None) -> float:
    """A diffusion from 0 to 1; else the default, or an error without one."""
    if value is not None and 0.0 <= value <= 1.0:
        return float(value)
    if default is None:
        raise ValueError("error diffusion is from 0 to 1")
    return default


def diffuse(rows: np.ndarray, palette: np.ndarray, diffusion: float, warm_up: bool = False) -> np.ndarray:
    """Indices by row and column of an array rows x width x components. With warm_up the first row only prepares the errors, and is left out of the result."""
    return diffuse_bands([rows], palette, diffusion, [warm_up])[0]


def diffuse_bands(bands: Sequence[np.ndarray], palette: np.ndarray, diffusion: float, warm_up: Sequence[bool]) -> list[np.ndarray]:
    """The same for bands of one width, side by side."""
    width, dim = bands[0].shape[1:]
    height = [len(b) - w for b, w in zip(bands, warm_up, strict=True)]
    tall = max(height)
    rows = np.zeros((tall + 1, width, len(bands), dim))  # row 0 is the warm-up
    for i, (b, w) in enumerate(zip(bands, warm_up, strict=True)):
        rows[1 - w : 1 + height[i], :, i] = b
    warm = np.array(warm_up, bool)[:, None]
    p = palette.astype(np.float64)
    planes = [p[None, :, k] for k in range(dim)]
    ahead = np.zeros((width + 2, len(bands), dim))
    out = np.zeros((tall + 1, width, len(bands)), np.int32)
    share = diffusion / 16
    for y in range(0 if warm.any() else 1, tall + 1):
        errors, ahead = ahead, np.zeros((width + 2, len(bands), dim))
        # The warm-up row goes backwards, and the band's first row forwards.
        step = -1 if y % 2 == 0 else 1
        here, line = rows[y], out[y]
        for x in range(width - 1, -1, -1) if step < 0 else range(width):
            v = here[x] + errors[x + 1]
            d = (v[:, 0, None] - planes[0]) ** 2
            for k in range(1, dim):
                d += (v[:, k, None] - planes[k]) ** 2
            j = d.argmin(axis=1)
            line[x] = j
            e = (v - p[j]) * share
            errors[x + 1 + step] += 7 * e
            ahead[x + 1 - step] += 3 * e
            ahead[x + 1] += 5 * e
            ahead[x + 1 + step] += e
        if y == 0:
            ahead *= warm  # a band without a row above begins without errors
    return [out[1 : 1 + h, :, i] for i, h in enumerate(height)]


#: Rows of a band, and bands that a task walks side by side.
ROWS_PER_BAND, SIDE_BY_SIDE = 256, 4


def dither(pixels: DataFrame, indices: DataFrame, palette: DataFrame, images: DataFrame, diffusion: float = DIFFUSION, components: Sequence[str] = ("r", "g", "b"), rows_per_band: int | None = ROWS_PER_BAND) -> DataFrame:
    """(image_id, pos, palette_idx), dithered. pixels has the components in the palette's space; images has width and height. The bands of an image
    are dithered each by itself; with None an image is one band, and one task's work.

    Nothing changes where the diffusion is 0 or no image has a palette; an image without a palette has no indices.
    """
    diffusion = checked_diffusion(diffusion)
    colors = palette.select("image_id", "palette_idx", "c0", "c1", "c2").limit(SENT_ROWS + 1).collect() if diffusion else []
    if not colors:
        return indices.select("image_id", "pos", "palette_idx")
    sizes = images.select(F.col("image_id").alias("of"), "width")
    px = pixels.join(sizes, F.col("image_id") == F.col("of")).select("image_id", "pos", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(components)], "width")
    y = F.floor(F.col("pos") / F.col("width"))
    if rows_per_band:
        own = px.withColumn("band", F.floor(y / rows_per_band)).withColumn("halo", F.lit(False))
        halo = px.where(((y + 1) % rows_per_band) == 0).withColumn("band", F.floor(y / rows_per_band) + 1).withColumn("halo", F.lit(True))
        px = own.unionByName(halo)
    else:
        px = px.withColumn("band", F.lit(0).cast("long")).withColumn("halo", F.lit(False))
    px = px.withColumn("task", F.floor(F.col("band") / SIDE_BY_SIDE))
    n = len(components)

    def walk(points: pd.DataFrame, entries: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        points = points.sort_values(["band", "pos"])
        width = int(points["width"].iloc[0])
        bands, warm, pos = [], [], []
        for _, band in points.groupby("band", sort=True):
            own = ~band["halo"].to_numpy()
            if own.any():
                bands.append(band[[f"v{i}" for i in range(n)]].to_numpy(np.float64).reshape(-1, width, n))
                warm.append(not own.all())
                pos.append(band["pos"].to_numpy()[own])
        if not bands or not len(entries):
            return pd.DataFrame({"image_id": [], "pos": [], "palette_idx": []})
        got = diffuse_bands(bands, entries, diffusion, warm)
        return pd.DataFrame({"image_id": points["image_id"].iloc[0], "pos": np.concatenate(pos), "palette_idx": ids[np.concatenate([g.ravel() for g in got])]})

    if len(colors) <= SENT_ROWS:
        table: dict[int, list] = {}
        for r in sorted(colors):
            table.setdefault(r[0], []).append(r)
        sent = {image: (np.array([r[2:] for r in rows], np.float64), np.array([r[1] for r in rows], np.int32)) for image, rows in table.items()}
        nothing = (np.zeros((0, 3)), np.zeros(0, np.int32))
        return px.groupBy("image_id", "task").applyInPandas(lambda key, points: walk(points, *sent.get(int(key[0]), nothing)), "image_id long, pos long, palette_idx int")
    # The palette goes to each task of its image.
    tasks = px.select(F.col("image_id").alias("of_image"), F.col("task").alias("of_task")).distinct()
    per_task = tasks.join(palette, F.col("of_image") == palette["image_id"]).select("of_image", "of_task", "palette_idx", "c0", "c1", "c2")

    def with_palette(key, points: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("palette_idx")
        return walk(points, entries[["c0", "c1", "c2"]].to_numpy(), entries["palette_idx"].to_numpy()) if len(points) else pd.DataFrame({"image_id": [], "pos": [], "palette_idx": []})

    return px.groupBy("image_id", "task").cogroup(per_task.groupBy("of_image", "of_task")).applyInPandas(with_palette, "image_id long, pos long, palette_idx int")
