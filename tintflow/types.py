"""Limits, validated values and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_PIXELS = 2**32 - 1
MAX_COLORS = 256
#: Pixels of an image that Python packs or unpacks at once.
PIECE = 1 << 16


class AboveMaxLen(ValueError):
    """More elements than a limit allows."""

    def __init__(self, limit: int):
        super().__init__(f"above the maximum length of {limit}")
        self.limit = limit


@dataclass(frozen=True)
class PaletteSize:
    """The most colours that a palette may have: 0 to 256."""

    value: int = MAX_COLORS

    def __post_init__(self):
        if isinstance(self.value, bool) or not isinstance(self.value, int) or self.value < 0:
            raise ValueError("a palette size is a whole number from 0")
        if self.value > MAX_COLORS:
            raise AboveMaxLen(MAX_COLORS)

    @classmethod
    def clamped(cls, value: int) -> PaletteSize:
        return cls(max(0, min(int(value), MAX_COLORS)))

    @classmethod
    def of(cls, value: int | PaletteSize | None) -> PaletteSize:
        return value if isinstance(value, cls) else cls() if value is None else cls(value)

    def __int__(self) -> int:
        return self.value

    def __str__(self) -> str:
        return str(self.value)


PIXELS = T.StructType([T.StructField("image_id", T.LongType(), False), T.StructField("pos", T.LongType(), False), *[T.StructField(c, T.LongType(), False) for c in "rgb"]])
IMAGES = T.StructType([T.StructField("image_id", T.LongType(), False), T.StructField("width", T.LongType(), False), T.StructField("height", T.LongType(), False)])
PALETTE = T.StructType([T.StructField("image_id", T.LongType(), False), T.StructField("palette_idx", T.IntegerType(), False), *[T.StructField(c, T.DoubleType(), False) for c in ("c0", "c1", "c2")], T.StructField("n", T.LongType(), False)])
INDICES = T.StructType([T.StructField("image_id", T.LongType(), False), T.StructField("pos", T.LongType(), False), T.StructField("palette_idx", T.IntegerType(), False)])


@dataclass
class QuantizeOutput:
    """A palette (image_id, palette_idx, components, n) and, where asked for, the pixels' indices into it (image_id, pos, palette_idx)."""

    palette: DataFrame
    indices: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> QuantizeOutput:
        return cls(spark.createDataFrame([], PALETTE), spark.createDataFrame([], INDICES))
