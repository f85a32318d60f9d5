"""How near a quantised image is to its original: mean squared error by colours, structural dissimilarity by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of luma in thousandths, and the constants of the structural similarity index for values up to 255,000.
LUMA = (299, 587, 114)
C1, C2 = (0.01 * 255_000) ** 2, (0.03 * 255_000) ** 2


def luma(r: Column, g: Column, b: Column) -> Column:
    return r.cast("long") * LUMA[0] + g.cast("long") * LUMA[1] + b.cast("long") * LUMA[2]


def dissimilarity(pixels: DataFrame, quantized: DataFrame, images: DataFrame, window: int = 8, scales: int = 4) -> DataFrame:
    """(image_id, dssim): 1/s - 1, where s is the mean structural similarity of luma over windows of window x window cells; a cell of scale s is the mean of
    2^s x 2^s pixels, and scales count alike. Both images need a position for each pixel; 0 is for equal ones."""
    q = quantized.select(F.col("image_id").alias("q_image"), F.col("pos").alias("q_pos"), luma(*[F.col(c) for c in "rgb"]).alias("b_"))
    p = pixels.select("image_id", "pos", luma(*[F.col(c) for c in "rgb"]).alias("a_"))
    sizes = images.select(F.col("image_id").alias("of"), "width")
    both = p.join(q, (F.col("image_id") == F.col("q_image")) & (F.col("pos") == F.col("q_pos"))).join(sizes, F.col("image_id") == F.col("of"))
    both = both.select("image_id", F.floor(F.col("pos") / F.col("width")).alias("y"), (F.col("pos") % F.col("width")).alias("x"), "a_", "b_", F.explode(F.sequence(F.lit(0), F.lit(scales - 1))).alias("scale"))
    cell = both.groupBy("image_id", "scale", F.expr("shiftright(x, scale)").alias("x"), F.expr("shiftright(y, scale)").alias("y")).agg((F.sum("a_") / F.count("*")).alias("a"), (F.sum("b_") / F.count("*")).alias("b"))
    a, b = F.col("a"), F.col("b")
    means = cell.groupBy("image_id", "scale", F.floor(F.col("x") / window).alias("wx"), F.floor(F.col("y") / window).alias("wy")).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"), F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab"))
    ma, mb = F.col("ma"), F.col("mb")
    similar = ((2 * ma * mb + C1) * (2 * (F.col("ab") - ma * mb) + C2)) / ((ma * ma + mb * mb + C1) * (F.col("aa") - ma * ma + F.col("bb") - mb * mb + C2))
    by_scale = means.groupBy("image_id", "scale").agg(F.avg(similar).alias("s"))
    return by_scale.groupBy("image_id").agg((1 / F.avg("s") - 1).alias("dssim"))
