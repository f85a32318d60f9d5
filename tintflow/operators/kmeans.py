"""K-means refinement of palettes by weighted sampling with replacement.

The j-th sample of a seed falls on a place among an image's pixels that depends on nothing else. The centroids are then moved sample by sample
(online), or batch by batch with the batch assigned to the centroids as they stood at its beginning (minibatch). That fold is sequential by its
nature and runs once for each image, over its distinct colours, or for vectors over a stream of samples in their order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..types import MAX_COLORS, AboveMaxLen
from .nearest import distances
from .sampling import place_column, places


@dataclass(frozen=True)
class KmeansOptions:
    sampling_factor: float = 0.5
    seed: int = 0
    batch_size: int = 4096
    mode: str = "minibatch"

    def __post_init__(self):
        if self.mode not in ("online", "minibatch"):
            raise ValueError("mode is online or minibatch")


def num_samples(factor: float, n: int) -> int:
    """The whole part of factor * n; 0 where that is negative or no number."""
    x = factor * n
    return 0 if math.isnan(x) or x <= 0 else min(int(x), 2**32 - 1)


class Centroids:
    """At most 256 vectors."""

    def __init__(self, values: Sequence[Sequence[float]]):
        if len(values) > MAX_COLORS:
            raise AboveMaxLen(MAX_COLORS)
        self.values = np.array(values, np.float32).reshape(len(values), -1)

    @classmethod
    def truncated(cls, values: Sequence[Sequence[float]]) -> Centroids:
        return cls(values[:MAX_COLORS])

    def __len__(self) -> int:
        return len(self.values)


class Fold:
    """Centroids that move towards samples: towards the n-th sample that one gets, by 1/sqrt(n) of the way."""

    def __init__(self, centroids: np.ndarray, batch: int | None):
        self.c, self.batch = centroids.astype(np.float64).copy(), batch
        self.count = np.zeros(len(self.c), np.int64)
        self.rest = np.zeros((0, self.c.shape[1] if self.c.ndim == 2 else 0))

    def add(self, samples: np.ndarray) -> Fold:
        """Takes samples in their order. With a batch size they are taken by whole batches, and what is left of one waits for more."""
        if not len(self.c) or self.batch is not None and self.batch <= 0:
            return self
        if self.batch is None:
            for x in samples.astype(np.float64):
                j = int(np.argmin(distances(x[None], self.c)[0]))
                self.count[j] += 1
                self.c[j] += (x - self.c[j]) * (1 / math.sqrt(self.count[j]))
            return self
        self.rest = np.concatenate([self.rest, samples.astype(np.float64)])
        while len(self.rest) >= self.batch:
            part, self.rest = self.rest[: self.batch], self.rest[self.batch :]
            self._move(part, np.argmin(distances(part, self.c), axis=1))
        return self

    def _move(self, part: np.ndarray, assigned: np.ndarray) -> None:
        """A batch's samples in their order: the first ones of all centroids together, then the second ones, and so on."""
        order = np.argsort(assigned, kind="stable")
        begin = np.flatnonzero(np.r_[True, assigned[order][1:] != assigned[order][:-1]])
        size = np.diff(np.r_[begin, len(order)])
        for k in range(int(size.max())):
            mine = order[begin[size > k] + k]
            j = assigned[mine]
            self.count[j] += 1
            self.c[j] += (part[mine] - self.c[j]) * (1 / np.sqrt(self.count[j]))[:, None]


def fold(samples: np.ndarray, centroids: np.ndarray, batch: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, counts) after all samples; what is left after the last whole batch is dropped."""
    done = Fold(centroids, batch).add(samples)
    return done.c, done.count


def draw(weights: np.ndarray, m: int, seed: int, first: int = 0) -> np.ndarray:
    """The rows that samples first, first + 1, ... to m - 1 fall on, with replacement, by whole weights: rows are laid end to end, and a sample's place is among them."""
    ends = np.cumsum(weights)
    if not len(ends) or not ends[-1] or m <= first:
        return np.zeros(0, np.int64)
    return np.searchsorted(ends, places(np.arange(first, m), int(ends[-1]), seed), "right")


#: Samples drawn at a time.
AT_ONCE = 1 << 16


def palette(colors: DataFrame, initial: DataFrame, options: KmeansOptions = KmeansOptions(), components: Sequence[str] = ("r", "g", "b"), whole: bool = True, weighted: bool = True) -> DataFrame:
    """(image_id, palette_idx, c0, c1, c2, n): the initial palettes, moved; n is the number of samples that an entry got.

    colors has image_id, r, g, b, n and the components. The number of samples is sampling_factor times the colours, or times the pixels if not
    weighted. Whole components are cut to whole numbers at the end. An image's distinct colours (2^24 at most) meet in one task.
    """
    batch = None if options.mode == "online" else options.batch_size

    def move(first: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        first = first.sort_values("palette_idx")
        points = points.sort_values(["r", "g", "b"])
        weights, values = points["n"].to_numpy(np.int64), points[list(components)].to_numpy(np.float64)
        m = num_samples(options.sampling_factor, len(points) if weighted else int(weights.sum()))
        moved = Fold(first[["c0", "c1", "c2"]].to_numpy(np.float64), batch)
        for lo in range(0, m, AT_ONCE):
            moved.add(values[draw(weights, min(m, lo + AT_ONCE), options.seed, lo)])
        c = np.trunc(np.clip(moved.c, 0, 255)) if whole else moved.c
        return pd.DataFrame({"image_id": first["image_id"].to_numpy(), "palette_idx": first["palette_idx"].to_numpy(), **{f"c{i}": c[:, i] if len(c) else np.zeros(0) for i in range(3)}, "n": moved.count})

    points = colors.select("image_id", *dict.fromkeys(["r", "g", "b", "n", *components]))
    grouped = initial.select("image_id", "palette_idx", "c0", "c1", "c2").groupBy("image_id").cogroup(points.groupBy("image_id"))
    return grouped.applyInPandas(lambda a, b: move(a, b) if len(a) else pd.DataFrame({c: [] for c in ("image_id", "palette_idx", "c0", "c1", "c2", "n")}), "image_id long, palette_idx int, c0 double, c1 double, c2 double, n long")


def indexed(vectors: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """idx: places 0, 1, ... of the rows in the order of the key. Rows are counted within stretches of the key (of its hash, if it is no number), and stretches moved by what is before them."""
    number = dict(vectors.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    v = vectors.withColumn("place", F.col(key).cast("long") if number else F.xxhash64(key))
    bounds = sorted(set(v.agg(F.percentile_approx("place", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []))
    v = v.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>"), lambda x: x < F.col("place"))))
    before = v.groupBy("bucket").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("bucket", "before")
    local = F.row_number().over(W.partitionBy("bucket").orderBy("place", key)) - 1
    return v.withColumn("local", local).join(F.broadcast(before), "bucket").withColumn("idx", F.col("before") + F.col("local")).drop("bucket", "local", "before", "place")


def refine_vectors(vectors: DataFrame, initial: DataFrame, key: str, vector: str, options: KmeansOptions = KmeansOptions()) -> DataFrame:
    """(palette_idx, the vector, n): centroids of arrays of any one length, moved by samples of the rows. initial has palette_idx and the vector, 256 rows at most.

    Samples are sorted by Spark and streamed through one task, which holds a batch of them.
    """
    total = vectors.count()
    m = num_samples(options.sampling_factor, total) if total else 0
    spark = vectors.sparkSession
    first = initial.select("palette_idx", F.col(vector).cast("array<double>").alias("v")).limit(MAX_COLORS + 1).collect()
    if len(first) > MAX_COLORS:
        raise AboveMaxLen(MAX_COLORS)
    first = sorted((r["palette_idx"], r["v"]) for r in first)
    schema = f"palette_idx int, `{vector}` array<double>, n long"
    if not m or not first:
        return spark.createDataFrame([(i, v, 0) for i, v in first], schema)
    ordinals = spark.range(m).select(F.col("id").alias("ordinal"), place_column(F.col("id"), total, options.seed).alias("idx"))
    drawn = ordinals.join(indexed(vectors.select(key, vector), key), "idx").select("ordinal", F.col(vector).cast("array<double>").alias("v"))
    batch = None if options.mode == "online" else options.batch_size

    def move(batches):
        moved = Fold(np.array([v for _, v in first]), batch)
        for b in batches:
            if b.num_rows:
                values = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                moved.add(values)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in first], pa.int32()), pa.array(moved.c.tolist(), pa.list_(pa.float64())), pa.array(moved.count, pa.int64())], names=["palette_idx", vector, "n"])

    return drawn.repartition(1).sortWithinPartitions("ordinal").mapInArrow(move, schema)
