"""Pixels from any table: (image_id, pos, r, g, b), where the order is a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import MAX_PIXELS, PIXELS, AboveMaxLen


def from_table(df: DataFrame, r: Column, g: Column, b: Column, pos: Column | None = None, image_id: Column | None = None, check: bool = True) -> DataFrame:
    """Pixels from expressions over a table's columns, checked as they are read. Without a position the pixels are an unordered multiset (pos is null)."""
    cols = [F.lit(0).cast("long").alias("image_id") if image_id is None else image_id.cast("long").alias("image_id"), F.lit(None).cast("long").alias("pos") if pos is None else pos.cast("long").alias("pos")]
    out = df.select(*cols, r.cast("long").alias("r"), g.cast("long").alias("g"), b.cast("long").alias("b"))
    return validated(out) if check else out


def color_slice(spark: SparkSession, colors: Sequence[Sequence[int]], image_id: int = 0) -> DataFrame:
    """Pixels from a list of colours, in its order."""
    if len(colors) > MAX_PIXELS:
        raise AboveMaxLen(MAX_PIXELS)
    for c in colors:
        if len(c) != 3 or any(not 0 <= int(x) <= 255 for x in c):
            raise ValueError(f"not a colour of three components from 0 to 255: {c!r}")
    return spark.createDataFrame([(image_id, i, *map(int, c)) for i, c in enumerate(colors)], PIXELS)


def empty_pixels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PIXELS)


def truncated(pixels: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """The first `most` pixels of each image, by position."""
    return pixels.where(F.col("pos") < F.lit(most))


def num_colors(pixels: DataFrame) -> int:
    return pixels.count()


def validated(pixels: DataFrame) -> DataFrame:
    """Pixels that are checked as they are read: a component that is null or outside 0..255 ends the query, and so does a position that no image of MAX_PIXELS has."""
    bad = F.lit(False)
    for c in "rgb":
        bad = bad | F.col(c).isNull() | ~F.col(c).between(0, 255)
    beyond = F.col("pos").isNotNull() & ~F.col("pos").between(0, MAX_PIXELS - 1)
    stop = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    # A filter is computed once a row; the columns stay as they are, so that what is built on them does not carry the check along.
    return pixels.where(F.when(bad, stop("a pixel's components are whole numbers from 0 to 255")).when(beyond, stop(f"a pixel's position is from 0 to {MAX_PIXELS - 1}")).otherwise(F.lit(True)))
