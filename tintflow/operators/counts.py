"""Distinct colours, their counts and their order; pixels to colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_color_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, n): each colour of an image once. Pixels that have an n already are counted so many times."""
    return pixels.groupBy("image_id", "r", "g", "b").agg((F.sum("n").cast("long") if "n" in pixels.columns else F.count("*")).alias("n"))


def red_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "r").agg(F.count("*").alias("n"))


def prefix_sums(counts: DataFrame, order: str, value: str = "n", name: str = "running") -> DataFrame:
    """Running sums within each image, over a small ordered table (one row a bucket)."""
    return counts.withColumn(name, F.sum(value).over(W.partitionBy("image_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def with_color_index(colors: DataFrame) -> DataFrame:
    """color_idx: a colour's place among its image's, in the order of r, g, b. Places are counted within each red, then moved by the number of colours of lower reds, so that no task holds an image's colours all."""
    reds = colors.groupBy("image_id", "r").agg(F.count("*").alias("m"))
    before = reds.withColumn("before", F.coalesce(F.sum("m").over(W.partitionBy("image_id").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("image_id", "r", "before")
    local = F.row_number().over(W.partitionBy("image_id", "r").orderBy("g", "b"))
    return colors.withColumn("local", local).join(before, ["image_id", "r"]).withColumn("color_idx", (F.col("before") + F.col("local") - 1).cast("long")).drop("local", "before")


def indexed_color_counts(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(colours with n and color_idx; pixels' color_idx as image_id, pos, color_idx)."""
    colors = with_color_index(unique_color_counts(pixels))
    return colors, pixels.join(colors.select("image_id", "r", "g", "b", "color_idx"), ["image_id", "r", "g", "b"]).select("image_id", "pos", "color_idx")


def totals(colors: DataFrame) -> DataFrame:
    """(image_id, total_count, num_colors) of a table of colours with n."""
    return colors.groupBy("image_id").agg(F.sum("n").cast("long").alias("total_count"), F.count("*").alias("num_colors"))


def remap(pixels: DataFrame, mapping: DataFrame, value: str = "palette_idx") -> DataFrame:
    """(image_id, pos, value): pixels to what their colour is mapped to. Join sides are the planner's choice: the mapping grows with the colours."""
    return pixels.join(mapping.select("image_id", "r", "g", "b", value), ["image_id", "r", "g", "b"]).select("image_id", "pos", value)
