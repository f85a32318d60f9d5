"""The nearest of a few vectors, for many."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import squared_distance, squared_distance_arrays
from ..types import MAX_COLORS, AboveMaxLen

#: Palettes of at most so many rows (images x 256) are sent to the executors; with more images they are joined.
SENT_ROWS = 1 << 18


def distances(points: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Squared distances, by point and palette entry, in double precision."""
    out = np.zeros((len(points), len(palette)))
    for d in range(points.shape[1]):
        out += np.subtract.outer(points[:, d], palette[:, d]) ** 2
    return out


def nearest(points: DataFrame, palette: DataFrame, components: Sequence[str] = ("c0", "c1", "c2"), keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The points with palette_idx of the nearest entry of their image's palette, and distance2. Of equal distances the lowest index wins; a point without a palette is left out."""
    rows = palette.select("image_id", "palette_idx", *components).limit(SENT_ROWS + 1).collect()
    if len(rows) <= SENT_ROWS:
        return _sent(points, rows, components)
    entries = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("palette_idx", *components))).alias("palette"))
    near = F.array_min(F.transform("palette", lambda p: F.struct(squared_distance([F.col(c).cast("double") for c in components], [p[c].cast("double") for c in components]).alias("d"), p["palette_idx"].alias("i"))))
    return points.join(entries, "image_id").withColumn("near", near).withColumn("palette_idx", F.col("near.i")).withColumn("distance2", F.col("near.d")).drop("near", "palette")


def _sent(points: DataFrame, rows: list, components: Sequence[str]) -> DataFrame:
    palettes: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        palettes.setdefault(r[0], []).append(r)
    table = {image: (np.array([r[1] for r in mine], np.int32), np.array([r[2:] for r in mine], np.float64)) for image, mine in palettes.items()}
    kinds = dict(points.dtypes)

    def assign(batches):
        for b in batches:
            images = b.column("image_id").to_numpy()
            p = np.stack([b.column(c).to_numpy().astype(np.float64) for c in components], axis=1) if b.num_rows else np.zeros((0, len(components)))
            index, d2 = np.full(len(images), -1, np.int32), np.zeros(len(images))
            for image in np.unique(images):
                if int(image) not in table:
                    continue
                ids, entries = table[int(image)]
                at = np.flatnonzero(images == image)
                for lo in range(0, len(at), 4096):
                    part = at[lo : lo + 4096]
                    d = distances(p[part], entries)
                    best = np.argmin(d, axis=1)
                    index[part], d2[part] = ids[best], d[np.arange(len(part)), best]
            keep = pa.array(index >= 0)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(index), pa.array(d2)], names=[*b.schema.names, "palette_idx", "distance2"])
            yield out.filter(keep)

    return points.mapInArrow(assign, ", ".join([*(f"`{c}` {kinds[c]}" for c in points.columns), "palette_idx int, distance2 double"]))


def nearest_vectors(vectors: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, palette_idx, distance2): the nearest centroid of arrays of any length, in the JVM. centroids has palette_idx and the array; more than 256 are an error."""
    few = centroids.select("palette_idx", F.col(vector).cast("array<double>").alias("v"))
    rows = few.limit(MAX_COLORS + 1).collect()
    if len(rows) > MAX_COLORS:
        raise AboveMaxLen(MAX_COLORS)
    entries = vectors.sparkSession.createDataFrame(rows, few.schema).agg(F.array_sort(F.collect_list(F.struct("palette_idx", "v"))).alias("palette"))
    near = F.array_min(F.transform("palette", lambda p: F.struct(squared_distance_arrays(F.col(vector), p["v"]).alias("d"), p["palette_idx"].alias("i"))))
    return vectors.select(key, vector).crossJoin(F.broadcast(entries)).select(key, near.alias("near")).select(key, F.col("near.i").alias("palette_idx"), F.col("near.d").alias("distance2"))


def distance_table(palette: DataFrame, components: Sequence[str] = ("c0", "c1", "c2")) -> DataFrame:
    """(image_id, i, j, quarter, rank): for each entry the palette by rising distance; quarter is a quarter of the squared distance. 256^2 rows an image at most."""
    a = palette.select("image_id", F.col("palette_idx").alias("i"), *[F.col(c).alias(f"a{n}") for n, c in enumerate(components)])
    b = palette.select("image_id", F.col("palette_idx").alias("j"), *[F.col(c).alias(f"b{n}") for n, c in enumerate(components)])
    d = squared_distance([F.col(f"a{n}").cast("double") for n in range(len(components))], [F.col(f"b{n}").cast("double") for n in range(len(components))]) / 4
    pairs = a.join(b, "image_id").select("image_id", "i", "j", d.alias("quarter"))
    return pairs.withColumn("rank", (F.row_number().over(W.partitionBy("image_id", "i").orderBy("quarter", "j")) - 1).cast("int"))
