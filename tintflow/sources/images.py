"""Image files by Spark's image source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import PIECE


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, origin, width, height, channels, data) of image files. Ids are a hash of the origin, so that they do not depend on how files are dealt."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return raw.select((F.xxhash64("origin")).alias("image_id"), "origin", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("nChannels").alias("channels"), "data")


def load_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_images(spark, paths)


def load_image_dir(spark: SparkSession, path: str) -> DataFrame:
    """A folder's images, in the order of their paths."""
    return read_images(spark, path).orderBy("origin")


def benchmark_images(spark: SparkSession, path: str) -> DataFrame:
    """Images in folders named WIDTHxHEIGHT below path, the largest folders first."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    size = F.regexp_extract("origin", r"/(\d+)x(\d+)/[^/]*$", 1).try_cast("long") * F.regexp_extract("origin", r"/(\d+)x(\d+)/[^/]*$", 2).try_cast("long")
    found = images.select(F.xxhash64("origin").alias("image_id"), "origin", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("nChannels").alias("channels"), "data", size.alias("folder_size"))
    return found.where("folder_size is not null").orderBy(F.col("folder_size").desc(), "origin")


def pixels_of(images: DataFrame) -> DataFrame:
    """(image_id, pos, r, g, b) of decoded images, row by row from the top. Spark keeps bytes as blue, green, red; grey images have one channel. Alpha is not supported.
    Images are cut into pieces before Python sees them."""

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("channels")[i].as_py()
                if n not in (1, 3):
                    raise ValueError(f"an image has {n} channels; 1 or 3 are supported")
                part = np.frombuffer(b.column("data")[i].as_buffer(), np.uint8).reshape(-1, n).astype(np.int64)
                ident, lo = b.column("image_id")[i].as_py(), b.column("at")[i].as_py() // n
                rgb = [part[:, 0]] * 3 if n == 1 else [part[:, 2], part[:, 1], part[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), ident)), pa.array(np.arange(lo, lo + len(part))), *map(pa.array, rgb)], names=["image_id", "pos", "r", "g", "b"])

    step = F.greatest(F.col("channels"), F.lit(1)) * PIECE
    last = F.greatest(F.length("data") - 1, F.lit(0))
    pieces = images.select("image_id", "channels", "data", F.explode(F.sequence(F.lit(0), last, step)).alias("at"))
    return pieces.select("image_id", "channels", "at", F.substring("data", F.col("at") + 1, step).alias("data")).mapInArrow(unpack, "image_id long, pos long, r long, g long, b long")
