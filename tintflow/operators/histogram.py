"""Histograms of colours: moments by cell, running sums over the grid, boxes, and the best places to cut them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import sum_of_squares

Box = Sequence[tuple[int, int]]
#: Steps a unit in which components of a space, and sums of their squares, are summed as whole numbers, so that sums do not depend on the order of rows.
SCALES = {"srgb": 1, "lab": 1 << 16, "oklab": 1 << 20}


def moments(colors: DataFrame, binner: Callable[..., Sequence[Column]], components: Sequence[str] = ("r", "g", "b"), scale: int = 1) -> DataFrame:
    """(image_id, b0, b1, b2, n, s0, s1, s2, ss) by cell, of colours weighted by n; without such a column each row counts once.

    Whole components (scale 1) give whole sums, and ss as a double; others are rounded to 1/scale, and their sums, ss too, are whole numbers of that unit.
    """
    n = F.col("n") if "n" in colors.columns else F.lit(1)
    c = [F.col(x) for x in components]
    binned = colors.select("image_id", *[b.alias(f"b{i}") for i, b in enumerate(binner(*c))], n.cast("long").alias("n"), *[x.cast("long" if scale == 1 else "double").alias(f"c{i}") for i, x in enumerate(c)])
    unit = (lambda x: x) if scale == 1 else (lambda x: F.rint(x * scale).cast("long"))
    comps = [F.col(f"c{i}") for i in range(3)]
    sums = [F.sum(F.col("n") * unit(x)).alias(f"s{i}") for i, x in enumerate(comps)]
    return binned.groupBy("image_id", "b0", "b1", "b2").agg(F.sum("n").alias("n"), *sums, F.sum(F.col("n") * unit(sum_of_squares(comps))).alias("ss"))


def cumulative(cells: DataFrame, bins: int, values: Sequence[str] = ("n", "s0", "s1", "s2", "ss")) -> DataFrame:
    """Running sums along the three axes on the whole grid of bins^3 cells an image."""
    spark = cells.sparkSession
    axis = spark.range(bins).select(F.col("id").cast("int").alias("b"))
    images = cells.select("image_id").distinct()
    grid = images.crossJoin(F.broadcast(axis.withColumnRenamed("b", "b0"))).crossJoin(F.broadcast(axis.withColumnRenamed("b", "b1"))).crossJoin(F.broadcast(axis.withColumnRenamed("b", "b2")))
    out = grid.join(cells, ["image_id", "b0", "b1", "b2"], "left").select("image_id", "b0", "b1", "b2", *[F.coalesce(F.col(v), F.lit(0).cast(dict(cells.dtypes)[v])).alias(v) for v in values])
    for axis_, others in (("b2", ("b0", "b1")), ("b1", ("b0", "b2")), ("b0", ("b1", "b2"))):
        w = W.partitionBy("image_id", *others).orderBy(axis_).rowsBetween(W.unboundedPreceding, 0)
        out = out.select("image_id", "b0", "b1", "b2", *[F.sum(v).over(w).alias(v) for v in values])
    return out


def inside(box: Box) -> Column:
    """Whether a cell lies in the box, whose bounds are (from, to) along each axis."""
    out = F.lit(True)
    for i, (lo, hi) in enumerate(box):
        out = out & (F.col(f"b{i}") >= lo) & (F.col(f"b{i}") < hi)
    return out


def is_single_bin(box: Box) -> bool:
    return all(hi - lo == 1 for lo, hi in box)


def volume(cells: DataFrame, box: Box) -> DataFrame:
    """(image_id, n, s0, s1, s2, ss) of the box."""
    return cells.where(inside(box)).groupBy("image_id").agg(*[F.sum(v).alias(v) for v in ("n", "s0", "s1", "s2", "ss")])


def variance(cells: DataFrame, box: Box) -> DataFrame:
    """(image_id, variance): the sum of squared distances from the box's mean; 0 for a single bin."""
    v = volume(cells, box)
    value = F.lit(0.0) if is_single_bin(box) else F.col("ss") - sum_of_squares([F.col(f"s{i}") for i in range(3)]) / F.col("n")
    return v.select("image_id", value.alias("variance"))


def mean_color(cells: DataFrame, box: Box, whole: bool = True) -> DataFrame:
    v = volume(cells, box)
    return v.select("image_id", *[(F.expr(f"s{i} div n") if whole else (F.col(f"s{i}") / F.col("n")).cast("float")).alias(f"c{i}") for i in range(3)], "n")


def cuts(cells: DataFrame, box: Box) -> DataFrame:
    """(image_id, axis, pos, n_upper, n_lower, score) of all places where the box can be cut with both sides filled; the least score is the best.

    The cells are read once: each is a part of a slab of all three axes.
    """
    values = ("n", "s0", "s1", "s2")
    slabs = cells.where(inside(box)).select("image_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"b{a}").alias("bin")) for a in range(3)])).alias("slab"), *values)
    slabs = slabs.groupBy("image_id", "slab.axis", "slab.bin").agg(*[F.sum(v).alias(v) for v in values])
    # A slab may be empty: every place in the box is a candidate, and the side before it ends with the slab before it.
    line = W.partitionBy("image_id", "axis")
    run = line.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    end = F.element_at(F.array(*[F.lit(hi) for _, hi in box]), F.col("axis") + 1)
    after = F.coalesce(F.lead("bin").over(line.orderBy("bin")), end)
    running = slabs.select("image_id", "axis", "bin", after.alias("next"), end.alias("end"), *[F.sum(v).over(run).alias(f"{v}u") for v in values], *[F.sum(v).over(line).alias(f"{v}t") for v in values])
    placed = running.where(F.col("bin") + 1 < F.col("end")).select("*", F.explode(F.sequence(F.col("bin") + 1, F.least(F.col("next"), F.col("end") - 1))).alias("pos"))
    n_lower = F.col("nt") - F.col("nu")
    upper = sum_of_squares([F.col(f"s{i}u") for i in range(3)]) / F.col("nu")
    lower = sum_of_squares([F.col(f"s{i}t") - F.col(f"s{i}u") for i in range(3)]) / n_lower
    return placed.where((F.col("nu") > 0) & (n_lower > 0)).select("image_id", "axis", "pos", F.col("nu").alias("n_upper"), n_lower.alias("n_lower"), (-(upper + lower)).alias("score"))


def best_cut(cells: DataFrame, box: Box, per_axis: bool = False) -> DataFrame:
    """The best place: of equal scores the lowest place, then the lowest axis."""
    keys = ["image_id", "axis"] if per_axis else ["image_id"]
    best = cuts(cells, box).groupBy(*keys).agg(F.min(F.struct("score", "axis", "pos", "n_upper", "n_lower")).alias("x"))
    return best.select("image_id", "x.axis", "x.pos", "x.n_upper", "x.n_lower", "x.score")
