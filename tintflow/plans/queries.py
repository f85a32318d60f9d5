"""Queries over the TPC-H-like tables seen as pixels, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import FloatBinner, UIntBinner, component_ranges, from_srgb, squared_distance, to_srgb
from ..operators import counts, dither, fidelity, histogram, kmeans, nearest, sampling, wu
from ..lineage import cut, ensure_checkpoint_dir
from ..sources import from_table, load_image_dir, palette_hex, pixels_of, points, quantized_pixels, read_images, truncated, write_image_files
from ..types import PALETTE
from .. import streaming
from . import oracles
from .pipeline import ImagePipeline, PalettePipeline, QuantizeMethod

WIDTH = 100
#: A palette for queries that need a fixed one: eight corners, and greys between.
FIXED = [(r, g, b) for r in (0, 255) for g in (0, 255) for b in (0, 255)] + [(64, 64, 64), (128, 128, 128), (192, 192, 192)]
BOX = ((0, 16), (4, 28), (0, 32))
WHOLE = ((0, 32),) * 3


def lineitem_px(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_of(spark.read.parquet(f"{d}/lineitem.parquet"))


def lineitem_of(t: DataFrame) -> DataFrame:
    return from_table(t, F.col("l_quantity").cast("long") * 5, F.round(F.col("l_discount") * 100).cast("long") * 25, F.round(F.col("l_tax") * 100).cast("long") * 31)


def events_px(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 60).when(F.col("event_type") == "purchase", 120).when(F.col("event_type") == "signup", 180).otherwise(240)
    return from_table(t, (F.col("user_id") * 37) % 256, F.least(F.lit(255), F.floor("value").cast("long")), kind, pos=F.col("event_id"))


def events_image(spark: SparkSession, d: str) -> DataFrame:
    px = events_px(spark, d)
    return px.groupBy("image_id").agg(F.lit(WIDTH).cast("long").alias("width"), F.floor(F.count("*") / WIDTH).cast("long").alias("height"))


def fixed_palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, i, *map(float, c), 0) for i, c in enumerate(FIXED)], PALETTE)


LINEITEM = "SELECT CAST(l_quantity AS BIGINT) * 5 AS r, CAST(round(l_discount * 100) AS BIGINT) * 25 AS g, CAST(round(l_tax * 100) AS BIGINT) * 31 AS b FROM lineitem"
EVENTS = "SELECT event_id AS pos, (user_id * 37) % 256 AS r, least(255, CAST(floor(value) AS BIGINT)) AS g, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 60 WHEN 'purchase' THEN 120 WHEN 'signup' THEN 180 ELSE 240 END AS BIGINT) AS b FROM events"
BINS = "CAST(r >> 3 AS INTEGER) AS b0, CAST(g >> 3 AS INTEGER) AS b1, CAST(b >> 3 AS INTEGER) AS b2"
CELLS = f"SELECT b0, b1, b2, CAST(count(*) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS s0, CAST(sum(g) AS BIGINT) AS s1, CAST(sum(b) AS BIGINT) AS s2, CAST(sum(r * r + g * g + b * b) AS DOUBLE) AS ss FROM (SELECT r, g, b, {BINS} FROM ({LINEITEM})) GROUP BY b0, b1, b2"
UNIQUE = f"SELECT r, g, b, CAST(count(*) AS BIGINT) AS n FROM ({LINEITEM}) GROUP BY r, g, b"
IN_BOX = " AND ".join(f"b{i} >= {lo} AND b{i} < {hi}" for i, (lo, hi) in enumerate(BOX))
PALETTE_SQL = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(FIXED))


def _oklab_sql(source: str) -> str:
    return f"SELECT r, g, b, c0, c1, c2 FROM ({oracles.converted(source, 'oklab')})"


def _lab_sql(source: str) -> str:
    return f"SELECT r, g, b, c0, c1, c2 FROM ({oracles.converted(source, 'lab')})"


def _cuts_sql(box) -> str:
    parts = []
    where = " AND ".join(f"b{i} >= {lo} AND b{i} < {hi}" for i, (lo, hi) in enumerate(box))
    for axis, (lo, hi) in enumerate(box):
        parts.append(f"SELECT {axis} AS axis, p AS pos, sum(n) FILTER (b{axis} < p) AS nu, sum(n) FILTER (b{axis} >= p) AS nl, {', '.join(f'CAST(sum(s{i}) FILTER (b{axis} < p) AS DOUBLE) AS u{i}, CAST(sum(s{i}) FILTER (b{axis} >= p) AS DOUBLE) AS l{i}' for i in range(3))} FROM cells, (SELECT unnest(range({lo + 1}, {hi})) AS p) WHERE {where} GROUP BY p")
    return f"WITH cells AS ({CELLS}), cut AS ({' UNION ALL '.join(parts)}) SELECT axis, pos, nu, nl, -((u0*u0+u1*u1+u2*u2)/nu + (l0*l0+l1*l1+l2*l2)/nl) AS score FROM cut WHERE nu > 0 AND nl > 0"


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query(f"SELECT pos, r, g, b FROM ({EVENTS}) WHERE pos < 500")
def pixel_scan_limit(spark, d):
    return truncated(events_px(spark, d), 500).select("pos", "r", "g", "b")


@query(UNIQUE)
def unique_color_counts(spark, d):
    return counts.unique_color_counts(lineitem_px(spark, d)).drop("image_id")


@query(f"SELECT pos, CAST(dense_rank() OVER (ORDER BY r, g, b) - 1 AS BIGINT) AS color_idx FROM ({EVENTS})")
def indexed_color_counts(spark, d):
    return counts.indexed_color_counts(events_px(spark, d))[1].select("pos", "color_idx")


@query(f"SELECT r, n, CAST(sum(n) OVER (ORDER BY r) AS BIGINT) AS running FROM (SELECT r, CAST(count(*) AS BIGINT) AS n FROM ({LINEITEM}) GROUP BY r)")
def red_histogram_prefix(spark, d):
    return counts.prefix_sums(counts.red_counts(lineitem_px(spark, d)), "r").drop("image_id")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total_count, CAST(count(*) AS BIGINT) AS num_colors FROM ({UNIQUE})")
def total_and_unique(spark, d):
    return counts.totals(counts.unique_color_counts(lineitem_px(spark, d))).drop("image_id")


def _binned(px: DataFrame, binner) -> DataFrame:
    return px.select(*[b.alias(f"b{i}") for i, b in enumerate(binner(F.col("r"), F.col("g"), F.col("b")))]).groupBy("b0", "b1", "b2").agg(F.count("*").alias("n"))


def _bin_sql(shift: int, scale: int = 1) -> str:
    return f"SELECT CAST((r * {scale}) >> {shift} AS INTEGER) AS b0, CAST((g * {scale}) >> {shift} AS INTEGER) AS b1, CAST((b * {scale}) >> {shift} AS INTEGER) AS b2, CAST(count(*) AS BIGINT) AS n FROM ({LINEITEM}) GROUP BY 1, 2, 3"


@query(_bin_sql(3))
def bin_uint_b32(spark, d):
    return _binned(lineitem_px(spark, d), UIntBinner(32))


@query(_bin_sql(2))
def bin_uint_b64(spark, d):
    return _binned(lineitem_px(spark, d), UIntBinner(64))


@query(_bin_sql(11, 257))
def bin_uint16(spark, d):
    px = lineitem_px(spark, d)
    return _binned(px.select(*[(F.col(c) * 257).alias(c) for c in "rgb"]), UIntBinner(32, 16))


def _converted(spark, d, space: str) -> DataFrame:
    px = counts.unique_color_counts(lineitem_px(spark, d))
    return px.select("r", "g", "b", *[c.alias(f"c{i}") for i, c in enumerate(from_srgb(F.col("r"), F.col("g"), F.col("b"), space))])


def _float_bin_sql() -> str:
    return f"SELECT r, g, b, {oracles.float_bins('oklab')} FROM ({_oklab_sql(UNIQUE)})"


@query(_float_bin_sql())
def bin_float_oklab(spark, d):
    colors = _converted(spark, d, "oklab")
    return colors.select("r", "g", "b", *[b.alias(f"b{i}") for i, b in enumerate(FloatBinner(component_ranges("oklab"))(*[F.col(f"c{i}") for i in range(3)]))])


@query(f"SELECT r, g, b, round(c0, 4) + 0.0 AS c0, round(c1, 4) + 0.0 AS c1, round(c2, 4) + 0.0 AS c2 FROM ({_oklab_sql(UNIQUE)})")
def srgb_to_oklab(spark, d):
    return _converted(spark, d, "oklab").select("r", "g", "b", *[(F.round(f"c{i}", 4) + 0.0).alias(f"c{i}") for i in range(3)])


@query(f"SELECT r, g, b, round(c0, 3) + 0.0 AS c0, round(c1, 3) + 0.0 AS c1, round(c2, 3) + 0.0 AS c2 FROM ({_lab_sql(UNIQUE)})")
def srgb_to_lab(spark, d):
    return _converted(spark, d, "lab").select("r", "g", "b", *[(F.round(f"c{i}", 3) + 0.0).alias(f"c{i}") for i in range(3)])


def _round_trip(spark, d, space: str) -> DataFrame:
    back = to_srgb(F.col("c0"), F.col("c1"), F.col("c2"), space)
    return _converted(spark, d, space).select("r", "g", "b", *[c.alias(f"{n}2") for c, n in zip(back, "rgb", strict=True)])


@query(f"SELECT r, g, b, r AS r2, g AS g2, b AS b2 FROM ({UNIQUE})")
def roundtrip_oklab(spark, d):
    return _round_trip(spark, d, "oklab")


@query(f"SELECT r, g, b, r AS r2, g AS g2, b AS b2 FROM ({UNIQUE})")
def roundtrip_lab(spark, d):
    return _round_trip(spark, d, "lab")


@query(CELLS)
def histogram_moments(spark, d):
    return histogram.moments(lineitem_px(spark, d), UIntBinner()).drop("image_id")


@query(CELLS)
def weighted_histogram_equals_raw(spark, d):
    return histogram.moments(counts.unique_color_counts(lineitem_px(spark, d)), UIntBinner()).drop("image_id")


_AXIS = "(SELECT CAST(unnest(range(32)) AS INTEGER) AS b)"
_FIVE = ("n", "s0", "s1", "s2", "ss")


def _cumulative_sql() -> str:
    out = f"SELECT x.b AS b0, y.b AS b1, z.b AS b2, {', '.join(f'coalesce(c.{v}, 0) AS {v}' for v in _FIVE)} FROM {_AXIS} x, {_AXIS} y, {_AXIS} z LEFT JOIN ({CELLS}) c ON c.b0 = x.b AND c.b1 = y.b AND c.b2 = z.b"
    for axis, others in (("b2", "b0, b1"), ("b1", "b0, b2"), ("b0", "b1, b2")):
        out = f"SELECT b0, b1, b2, {', '.join(f'sum({v}) OVER (PARTITION BY {others} ORDER BY {axis}) AS {v}' for v in _FIVE)} FROM ({out})"
    return f"SELECT b0, b1, b2, {', '.join(f'CAST({v} AS BIGINT) AS {v}' for v in _FIVE[:4])}, CAST(ss AS DOUBLE) AS ss FROM ({out})"


@query(_cumulative_sql())
def cumulative_moments(spark, d):
    return histogram.cumulative(histogram.moments(lineitem_px(spark, d), UIntBinner()), 32).drop("image_id")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(s0) AS BIGINT) AS s0, CAST(sum(s1) AS BIGINT) AS s1, CAST(sum(s2) AS BIGINT) AS s2, sum(ss) AS ss FROM ({CELLS}) WHERE {IN_BOX}")
def box_volume(spark, d):
    return histogram.volume(histogram.moments(lineitem_px(spark, d), UIntBinner()), BOX).drop("image_id")


@query(f"SELECT round(sum(ss) - (pow(CAST(sum(s0) AS DOUBLE), 2) + pow(CAST(sum(s1) AS DOUBLE), 2) + pow(CAST(sum(s2) AS DOUBLE), 2)) / sum(n), 2) AS variance FROM ({CELLS}) WHERE {IN_BOX}")
def box_variance(spark, d):
    return histogram.variance(histogram.moments(lineitem_px(spark, d), UIntBinner()), BOX).select(F.round("variance", 2).alias("variance"))


@query(f"SELECT CAST(sum(s0) // sum(n) AS BIGINT) AS c0, CAST(sum(s1) // sum(n) AS BIGINT) AS c1, CAST(sum(s2) // sum(n) AS BIGINT) AS c2, CAST(sum(n) AS BIGINT) AS n FROM ({CELLS}) WHERE {IN_BOX}")
def box_mean_color(spark, d):
    return histogram.mean_color(histogram.moments(lineitem_px(spark, d), UIntBinner()), BOX).drop("image_id")


@query(f"SELECT CAST(axis AS INTEGER) AS axis, CAST(pos AS INTEGER) AS pos, CAST(nu AS BIGINT) AS n_upper, CAST(nl AS BIGINT) AS n_lower, round(score, 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY score, pos) AS k FROM ({_cuts_sql(BOX)})) WHERE k = 1")
def best_cut_per_axis(spark, d):
    cells = histogram.moments(lineitem_px(spark, d), UIntBinner())
    return histogram.best_cut(cells, BOX, per_axis=True).select("axis", "pos", "n_upper", "n_lower", F.round("score", 1).alias("score"))


@query(f"SELECT CAST(axis AS INTEGER) AS axis, CAST(pos AS INTEGER) AS pos, CAST(nu AS BIGINT) AS n_upper, CAST(nl AS BIGINT) AS n_lower, round(score, 1) AS score FROM ({_cuts_sql(WHOLE)}) ORDER BY score, axis, pos LIMIT 1")
def best_first_cut(spark, d):
    cells = histogram.moments(lineitem_px(spark, d), UIntBinner())
    return histogram.best_cut(cells, WHOLE).select("axis", "pos", "n_upper", "n_lower", F.round("score", 1).alias("score"))


@query(f"WITH best AS (SELECT axis, pos FROM ({_cuts_sql(WHOLE)}) ORDER BY axis * 0 + score, axis, pos LIMIT 1), half AS (SELECT c.*, CASE WHEN CASE axis WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END < pos THEN 0 ELSE 1 END AS palette_idx FROM ({CELLS}) c, best) SELECT CAST(palette_idx AS INTEGER) AS palette_idx, CAST(sum(s0) // sum(n) AS BIGINT) AS r, CAST(sum(s1) // sum(n) AS BIGINT) AS g, CAST(sum(s2) // sum(n) AS BIGINT) AS b, CAST(sum(n) AS BIGINT) AS n FROM half GROUP BY palette_idx")
def wu_palette_k2(spark, d):
    return PalettePipeline(lineitem_px(spark, d)).palette_size(2).palette().drop("image_id")


def _palette_sql(source: str, space: str, k: int, *method) -> str:
    return f"SELECT palette_idx, r, g, b, n FROM ({oracles.to_srgb(oracles.palette(source, space, k, *method), space)})"


@query(_palette_sql(LINEITEM, "srgb", 16))
def wu_palette_k16(spark, d):
    return PalettePipeline(lineitem_px(spark, d)).palette_size(16).palette().drop("image_id")


@query(_palette_sql(LINEITEM, "srgb", 256))
def wu_palette_k256(spark, d):
    return PalettePipeline(lineitem_px(spark, d)).palette().drop("image_id")


@query(_palette_sql(LINEITEM, "oklab", 64))
def wu_palette_oklab(spark, d):
    return PalettePipeline(lineitem_px(spark, d)).colorspace("oklab").palette_size(64).palette().drop("image_id")


@query(_palette_sql(LINEITEM, "lab", 64))
def wu_palette_lab(spark, d):
    return PalettePipeline(lineitem_px(spark, d)).colorspace("lab").palette_size(64).palette().drop("image_id")


@query("SELECT CAST(256 AS BIGINT) AS colors, CAST(count(*) AS BIGINT) AS pixels FROM lineitem")
def wu_counts_sum(spark, d):
    return wu_palette_k256(spark, d).agg(F.count("*").alias("colors"), F.sum("n").alias("pixels"))


@query("SELECT CAST(count(*) AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS differing FROM events")
def wu_index_counts(spark, d):
    """The pixels that point to each palette colour are as many as its count says."""
    out = ImagePipeline(events_px(spark, d), events_image(spark, d), check=False).dither(False).palette_size(64).indexed_palette()
    pointed = out.indices.groupBy("palette_idx").agg(F.count("*").alias("m"))
    both = out.palette.join(pointed, "palette_idx", "full")
    return both.agg(F.sum("m").alias("pixels"), F.sum(F.when(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0)), 1).otherwise(0)).cast("long").alias("differing"))


_FIXED_BOXES = [(0, (0, 16), (0, 32), (0, 32)), (1, (16, 32), (0, 16), (0, 32)), (2, (16, 32), (16, 32), (0, 8)), (3, (16, 32), (16, 32), (8, 32))]


@query(f"SELECT CAST(palette_idx AS INTEGER) AS palette_idx, CAST(count(*) AS BIGINT) AS n FROM (SELECT r, g, b, {BINS} FROM ({LINEITEM})) JOIN (VALUES {', '.join(str((i, *x, *y, *z)) for i, x, y, z in _FIXED_BOXES)}) AS t(palette_idx, lo0, hi0, lo1, hi1, lo2, hi2) ON b0 >= lo0 AND b0 < hi0 AND b1 >= lo1 AND b1 < hi1 AND b2 >= lo2 AND b2 < hi2 GROUP BY palette_idx")
def wu_lookup_fixed_boxes(spark, d):
    boxes = spark.createDataFrame([(0, i, *x, *y, *z) for i, x, y, z in _FIXED_BOXES], "image_id long, palette_idx int, lo0 int, hi0 int, lo1 int, hi1 int, lo2 int, hi2 int")
    return wu.lookup(lineitem_px(spark, d), boxes, UIntBinner()).groupBy("palette_idx").agg(F.count("*").alias("n"))


_NEAREST = f"SELECT r, g, b, n, i, d2 FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d2, i) AS k FROM (SELECT u.r, u.g, u.b, u.n, p.i, (u.r - p.r) * (u.r - p.r) + (u.g - p.g) * (u.g - p.g) + (u.b - p.b) * (u.b - p.b) AS d2 FROM ({UNIQUE}) u, (VALUES {PALETTE_SQL}) AS p(i, r, g, b))) WHERE k = 1"


@query(f"SELECT r, g, b, CAST(i AS INTEGER) AS palette_idx, CAST(d2 AS DOUBLE) AS distance2 FROM ({_NEAREST})")
def nearest_fixed_palette(spark, d):
    return nearest.nearest(counts.unique_color_counts(lineitem_px(spark, d)).drop("n"), _rgb_palette(spark), ("r", "g", "b")).drop("image_id")


def _rgb_palette(spark) -> DataFrame:
    return fixed_palette(spark).select("image_id", "palette_idx", F.col("c0").cast("long").alias("r"), F.col("c1").cast("long").alias("g"), F.col("c2").cast("long").alias("b"))


@query("WITH c AS (SELECT label, dim, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(range(1, 65)) AS dim, unnest(embedding) AS v FROM embeddings) GROUP BY label, dim), e AS (SELECT vec_id, unnest(range(1, 65)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), dist AS (SELECT vec_id, label, sum((v - m) * (v - m)) AS d2 FROM e JOIN c USING (dim) GROUP BY vec_id, label) SELECT vec_id, CAST(label AS INTEGER) AS palette_idx, round(d2, 6) AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) AS k FROM dist) WHERE k = 1")
def nearest_embeddings(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    means = e.groupBy(F.col("label").alias("palette_idx")).agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("embedding"))
    return nearest.nearest_vectors(e, means, "vec_id", "embedding").select("vec_id", "palette_idx", F.round("distance2", 6).alias("distance2"))


@query(f"SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CAST(((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b)) / 4.0 AS DOUBLE) AS quarter, CAST(row_number() OVER (PARTITION BY a.i ORDER BY (a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b), b.i) - 1 AS INTEGER) AS rank FROM (VALUES {PALETTE_SQL}) AS a(i, r, g, b), (VALUES {PALETTE_SQL}) AS b(i, r, g, b)")
def palette_distance_table(spark, d):
    return nearest.distance_table(fixed_palette(spark)).drop("image_id")


@query(f"SELECT round(CAST(sum(d2 * n) AS DOUBLE) / sum(n), 6) AS mse FROM ({_NEAREST})")
def quantization_mse_fixed_palette(spark, d):
    near = nearest.nearest(counts.unique_color_counts(lineitem_px(spark, d)), _rgb_palette(spark), ("r", "g", "b"))
    return near.agg(F.round(F.sum(F.col("distance2") * F.col("n")) / F.sum("n"), 6).alias("mse"))


@query(f"SELECT string_agg(printf('%02X%02X%02X', r, g, b), ' ' ORDER BY i) AS palette FROM (VALUES {PALETTE_SQL}) AS p(i, r, g, b)")
def palette_hex_text(spark, d):
    return palette_hex(_rgb_palette(spark)).drop("image_id")


@query(f"SELECT CAST(i AS INTEGER) AS palette_idx, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(0 AS BIGINT) AS n FROM (VALUES {PALETTE_SQL}) AS p(i, r, g, b)")
def kmeans_zero_samples(spark, d):
    colors = counts.unique_color_counts(lineitem_px(spark, d))
    moved = kmeans.palette(colors, fixed_palette(spark), kmeans.KmeansOptions(sampling_factor=0.0))
    return moved.select("palette_idx", *[F.col(f"c{i}").cast("long").alias(n) for i, n in enumerate("rgb")], "n")


@query(_palette_sql(LINEITEM, "srgb", 32, None, 0.5, 1))
def kmeans_online(spark, d):
    method = QuantizeMethod.with_kmeans(mode="online", seed=1)
    return PalettePipeline(lineitem_px(spark, d)).palette_size(32).quantize_method(method).palette().drop("image_id")


@query(_palette_sql(LINEITEM, "oklab", 32, 256, 0.5, 1))
def kmeans_minibatch(spark, d):
    method = QuantizeMethod.with_kmeans(batch_size=256, seed=1)
    return PalettePipeline(lineitem_px(spark, d)).colorspace("oklab").palette_size(32).quantize_method(method).palette().drop("image_id")


@query(f"SELECT CAST(floor(0.5 * count(*)) AS BIGINT) AS samples FROM ({UNIQUE})")
def kmeans_sample_count(spark, d):
    return kmeans_online(spark, d).agg(F.sum("n").alias("samples"))


@query(oracles.embeddings_sql(64, 64))
def kmeans_embeddings(spark, d):
    """The labels' mean vectors, moved by samples of the vectors; and how many vectors are nearest to each."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    means = e.groupBy(F.col("label").alias("palette_idx")).agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("embedding"))
    moved = kmeans.refine_vectors(e, means, "vec_id", "embedding", kmeans.KmeansOptions(sampling_factor=1.0, batch_size=64))
    near = nearest.nearest_vectors(e, moved, "vec_id", "embedding")
    return moved.select("palette_idx", "n").join(near.groupBy("palette_idx").agg(F.count("*").alias("vectors")), "palette_idx", "left")


@query("SELECT DISTINCT CAST(label AS INTEGER) AS palette_idx, CAST(0 AS BIGINT) AS n FROM embeddings")
def kmeans_embeddings_zero_samples(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    means = e.groupBy(F.col("label").alias("palette_idx")).agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("embedding"))
    return kmeans.refine_vectors(e, means, "vec_id", "embedding", kmeans.KmeansOptions(sampling_factor=0.0)).select("palette_idx", "n")


@query(f"SELECT concat(CAST(g AS VARCHAR), ' ', CAST(b AS VARCHAR), ' ', CAST(r AS VARCHAR), ' ', CAST(n AS VARCHAR), ' 0x', printf('%02X%02X%02X', r, g, b)) AS line, 'Colors' AS block FROM ({UNIQUE}) WHERE n >= 16")
def point_dump(spark, d):
    colors = counts.unique_color_counts(lineitem_px(spark, d))
    return points(colors.select("n", "r", "g", "b", F.col("r").alias("c0"), F.col("g").alias("c1"), F.col("b").alias("c2")), "Colors", 16)


_EXACT = "SELECT event_id AS pos, CAST(event_id % 11 AS INTEGER) AS palette_idx FROM events"


def _exact_image(spark, d) -> tuple[DataFrame, DataFrame]:
    """Pixels that are palette colours, and their indices."""
    px = events_px(spark, d).withColumn("palette_idx", (F.col("pos") % len(FIXED)).cast("int")).select("image_id", "pos", "palette_idx")
    return px.join(fixed_palette(spark).select("palette_idx", *[F.col(f"c{i}").alias(n) for i, n in enumerate("rgb")]), "palette_idx").select("image_id", "pos", "r", "g", "b"), px


@query(_EXACT)
def dither_exact_image(spark, d):
    px, indices = _exact_image(spark, d)
    return dither.dither(px, indices, fixed_palette(spark), events_image(spark, d)).select("pos", "palette_idx")


@query(_EXACT)
def dither_exact_image_banded(spark, d):
    px, indices = _exact_image(spark, d)
    return dither.dither(px, indices, fixed_palette(spark), events_image(spark, d), rows_per_band=16).select("pos", "palette_idx")


@query(f"SELECT pos, CAST(i AS INTEGER) AS palette_idx FROM ({EVENTS}) e JOIN ({_NEAREST.replace(LINEITEM, EVENTS)}) u USING (r, g, b)")
def dither_zero_diffusion(spark, d):
    px = events_px(spark, d)
    near = nearest.nearest(counts.unique_color_counts(px), _rgb_palette(spark), ("r", "g", "b"))
    return dither.dither(px, counts.remap(px, near), fixed_palette(spark), events_image(spark, d), 0.0).select("pos", "palette_idx")


@query(oracles.dithered(EVENTS, "srgb", 32, WIDTH, 256))
def dither_image(spark, d):
    out = ImagePipeline(events_px(spark, d), events_image(spark, d), check=False).palette_size(32).indexed_palette()
    return out.indices.select("pos", "palette_idx")


@query(oracles.dithered(EVENTS, "oklab", 32, WIDTH, 64))
def dither_banded(spark, d):
    out = ImagePipeline(events_px(spark, d), events_image(spark, d), check=False).colorspace("oklab").palette_size(32).indexed_palette(rows_per_band=64)
    return out.indices.select("pos", "palette_idx")


@query(f"SELECT pos, CAST(p.r AS BIGINT) AS r, CAST(p.g AS BIGINT) AS g, CAST(p.b AS BIGINT) AS b FROM ({EVENTS}) e JOIN ({_NEAREST.replace(LINEITEM, EVENTS)}) u USING (r, g, b) JOIN (VALUES {PALETTE_SQL}) AS p(i, r, g, b) ON p.i = u.i")
def quantized_image_fixed_palette(spark, d):
    px = events_px(spark, d)
    near = nearest.nearest(counts.unique_color_counts(px), _rgb_palette(spark), ("r", "g", "b"))
    return quantized_pixels(counts.remap(px, near), _rgb_palette(spark)).drop("image_id")


@query(f"SELECT e.pos, p.r, p.g, p.b FROM ({EVENTS}) e JOIN ({oracles.assigned(EVENTS, 'oklab', 64, 256)}) a USING (r, g, b) JOIN ({_palette_sql(EVENTS, 'oklab', 64, 256)}) p USING (palette_idx)")
def quantized_image(spark, d):
    method = QuantizeMethod.with_kmeans(batch_size=256)
    return ImagePipeline(events_px(spark, d), events_image(spark, d), check=False).palette_size(64).colorspace("oklab").quantize_method(method).dither(False).quantized_pixels().drop("image_id")


def mean_squared_error(pipeline: PalettePipeline) -> DataFrame:
    """(image_id, mse) of pixels against their palette colours, by distinct colours."""
    palette, assigned = pipeline.assigned_colors()
    p = pipeline._converted(palette).select("image_id", "palette_idx", *[F.col(c).alias(f"{c}q") for c in "rgb"])
    d = squared_distance([F.col(c) for c in "rgb"], [F.col(f"{c}q") for c in "rgb"])
    return assigned.join(p, ["image_id", "palette_idx"]).groupBy("image_id").agg((F.sum(d * F.col("n")) / F.sum("n")).alias("mse"))


def _mse_sql(k: int, *method) -> str:
    d = "(a.r - p.r) * (a.r - p.r) + (a.g - p.g) * (a.g - p.g) + (a.b - p.b) * (a.b - p.b)"
    return f"(SELECT CAST(sum(({d}) * a.n) AS DOUBLE) / sum(a.n) FROM ({oracles.assigned(EVENTS, 'srgb', k, *method)}) a JOIN ({_palette_sql(EVENTS, 'srgb', k, *method)}) p USING (palette_idx))"


_PIVOT = " UNION ALL ".join(f"SELECT '{name}' AS method, round({_mse_sql(16, *m)}, 6) AS k16, round({_mse_sql(64, *m)}, 6) AS k64" for name, m in (("boxes", ()), ("kmeans", (256,))))


@query(_PIVOT)
def accuracy_pivot(spark, d):
    """Mean squared errors by method and palette size; colours are counted once for all."""
    colors = cut(counts.unique_color_counts(events_px(spark, d)))
    methods = {"boxes": QuantizeMethod.wu(), "kmeans": QuantizeMethod.with_kmeans(batch_size=256)}
    out = None
    for name, method in methods.items():
        for k in (16, 64):
            part = mean_squared_error(PalettePipeline(colors).palette_size(k).quantize_method(method)).select(F.lit(name).alias("method"), F.lit(k).alias("k"), "mse")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("method").pivot("k", [16, 64]).agg(F.round(F.first("mse"), 6)).withColumnsRenamed({"16": "k16", "64": "k64"})


def _dssim_sql(*method, dither: bool = False) -> str:
    indices = oracles.dithered(EVENTS, "srgb", 16, WIDTH, 256, *method) if dither else f"SELECT e.pos, a.palette_idx FROM ({EVENTS}) e JOIN ({oracles.assigned(EVENTS, 'srgb', 16, *method)}) a USING (r, g, b)"
    return oracles.dissimilarity(EVENTS, f"SELECT i.pos, p.r, p.g, p.b FROM ({indices}) i JOIN ({_palette_sql(EVENTS, 'srgb', 16, *method)}) p USING (palette_idx)", WIDTH)


@query(" UNION ALL ".join(f"SELECT '{name}' AS method, {d} AS dithered, round((SELECT dssim FROM ({_dssim_sql(*m, dither=d)})), 6) AS dssim" for name, m, d in (("boxes", (), False), ("boxes", (), True), ("kmeans", (256,), False))))
def dissimilarity_report(spark, d):
    """Structural dissimilarity of 16 colours by method, with and without dithering."""
    px, im = events_px(spark, d), events_image(spark, d)
    out = None
    for name, method, on in (("boxes", QuantizeMethod.wu(), False), ("boxes", QuantizeMethod.wu(), True), ("kmeans", QuantizeMethod.with_kmeans(batch_size=256), False)):
        q = ImagePipeline(px, im, check=False).palette_size(16).quantize_method(method).dither(on).quantized_pixels()
        part = fidelity.dissimilarity(px, q, im).select(F.lit(name).alias("method"), F.lit(on).alias("dithered"), F.round("dssim", 6).alias("dssim"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT pos, r, g, b FROM ({EVENTS})")
def image_file_round_trip(spark, d):
    """Pixels written as an image file and decoded again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/images-{uuid.uuid4()}"
    write_image_files(events_px(spark, d), events_image(spark, d), folder)
    return pixels_of(load_image_dir(spark, folder)).drop("image_id")


@query(f"SELECT r, g, b, CAST(count(*) AS BIGINT) AS n FROM ({EVENTS}) GROUP BY r, g, b")
def image_file_colors(spark, d):
    """Distinct colours of a decoded image file."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/images-{uuid.uuid4()}"
    write_image_files(events_px(spark, d), events_image(spark, d), folder)
    return counts.unique_color_counts(pixels_of(read_images(spark, folder))).drop("image_id")


@query(_palette_sql(EVENTS, "srgb", 8))
def image_pipeline_checked(spark, d):
    """An image whose size is held against the number of its pixels."""
    return ImagePipeline(events_px(spark, d), events_image(spark, d)).palette_size(8).palette().drop("image_id")


@query(f"SELECT CAST(r >> 5 AS INTEGER) AS b0, CAST(g // 50 AS INTEGER) AS b1, CAST(b >> 7 AS INTEGER) AS b2, CAST(count(*) AS BIGINT) AS n FROM ({LINEITEM}) GROUP BY 1, 2, 3")
def own_binner(spark, d):
    """A binner is any callable from three columns to three."""
    binner = lambda r, g, b: [F.shiftright(r, 5).cast("int"), F.floor(g / 50).cast("int"), F.shiftright(b, 7).cast("int")]
    return histogram.moments(lineitem_px(spark, d), binner).select("b0", "b1", "b2", "n")


@query("SELECT 0.0::DOUBLE AS variance")
def single_bin_variance(spark, d):
    cells = histogram.moments(lineitem_px(spark, d), UIntBinner())
    one = cells.orderBy("b0", "b1", "b2").first()
    return histogram.variance(cells, tuple((one[f"b{i}"], one[f"b{i}"] + 1) for i in range(3))).select("variance")


@query(_palette_sql(LINEITEM, "oklab", 16))
def wu_palette_without_dedup(spark, d):
    return PalettePipeline(lineitem_px(spark, d)).colorspace("oklab").palette_size(16).dedup_pixels(False).palette().drop("image_id")


@query(f"SELECT palette_idx, c0, c1, c2, n FROM ({oracles.palette(LINEITEM, 'srgb', 24)})")
def wu_palette_of_colors(spark, d):
    return wu.palette(counts.unique_color_counts(lineitem_px(spark, d)), 24).drop("image_id")


@query(f"SELECT r, g, b, CAST(n AS BIGINT) AS n, palette_idx FROM ({oracles.assigned(LINEITEM, 'srgb', 24)})")
def wu_indexed_colors(spark, d):
    return wu.indexed_palette(counts.unique_color_counts(lineitem_px(spark, d)), 24)[1].select("r", "g", "b", "n", "palette_idx")


@query(oracles.dithered(EVENTS, "lab", 12, WIDTH, 256, diffusion=0.5))
def dither_half_diffusion(spark, d):
    pipe = ImagePipeline(events_px(spark, d), events_image(spark, d), check=False).colorspace("lab").palette_size(12).dither_error_diffusion(0.5)
    return pipe.indexed_palette().indices.select("pos", "palette_idx")


@query(f"SELECT ordinal, {sampling.places_sql('ordinal', '(SELECT count(*) FROM lineitem)', 5)} AS place FROM (SELECT unnest(range(2000)) AS ordinal)")
def sample_places(spark, d):
    """Where samples fall among the rows of a table."""
    n = lineitem_px(spark, d).count()
    return spark.range(2000).select(F.col("id").alias("ordinal"), sampling.place_column(F.col("id"), n, 5).alias("place"))


@query(CELLS)
def streaming_histogram(spark, d):
    """The histogram of a table that is read as a stream, as it stands at the stream's end."""
    return streaming.final_moments(lineitem_of(streaming.read_table_as_stream(spark, d, "lineitem.parquet")), f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4()}").drop("image_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
