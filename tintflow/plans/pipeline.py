"""From pixels to palettes and quantised images, with the plan chosen by the options.

Lab and Oklab colours are converted once for each distinct colour. sRGB with boxes alone needs no distinct colours, as cells are summed from
pixels directly; everywhere else they are worth their shuffle unless dedup_pixels is off.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import default_binner
from ..functions.colorspace import ColorSpace, from_srgb, to_srgb
from ..lineage import cut
from ..operators import counts, histogram, kmeans, nearest, wu
from ..operators import dither as diffusion
from ..sources import images as image_source
from ..sources import sinks
from ..types import PaletteSize, QuantizeOutput

KmeansOptions = kmeans.KmeansOptions


def settled(df: DataFrame) -> DataFrame:
    """A table of at most 256 rows an image, computed now: kept by the driver up to SENT_ROWS rows, and written to the shared folder beyond."""
    rows = df.limit(nearest.SENT_ROWS + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= nearest.SENT_ROWS else cut(df)


@dataclass(frozen=True)
class QuantizeMethod:
    """Boxes alone, or boxes refined by k-means."""

    kmeans: KmeansOptions | None = None

    @classmethod
    def wu(cls) -> QuantizeMethod:
        return cls()

    @classmethod
    def with_kmeans(cls, **options: Any) -> QuantizeMethod:
        return cls(KmeansOptions(**options))


@dataclass(frozen=True)
class _Options:
    palette_size: PaletteSize = field(default_factory=PaletteSize)
    colorspace: ColorSpace = ColorSpace.SRGB
    method: QuantizeMethod = field(default_factory=QuantizeMethod)
    dedup_pixels: bool = True
    dither: bool = True
    error_diffusion: float = diffusion.DIFFUSION


class PalettePipeline:
    """Palettes of the images of a pixel table. Options return a new pipeline."""

    def __init__(self, pixels: DataFrame, options: _Options | None = None):
        self.pixels, self.options = pixels, options or _Options()

    @classmethod
    def from_images(cls, images: DataFrame) -> PalettePipeline:
        return cls(image_source.pixels_of(images))

    def _with(self, **changes: Any):
        out = object.__new__(type(self))
        out.__dict__ = self.__dict__ | {"options": replace(self.options, **changes)}
        return out

    def palette_size(self, size: int | PaletteSize):
        return self._with(palette_size=PaletteSize.of(size))

    def colorspace(self, space: str | ColorSpace):
        return self._with(colorspace=ColorSpace.of(space))

    def quantize_method(self, method: QuantizeMethod):
        return self._with(method=method)

    def dedup_pixels(self, on: bool):
        return self._with(dedup_pixels=on)

    def _colors(self) -> DataFrame:
        """(image_id, r, g, b, n, c0, c1, c2), once for each colour or for each pixel."""
        o = self.options
        plain = o.colorspace is ColorSpace.SRGB
        n = F.col("n") if "n" in self.pixels.columns else F.lit(1)
        colors = counts.unique_color_counts(self.pixels) if self._distinct() else self.pixels.select("image_id", "r", "g", "b", n.cast("long").alias("n"))
        return colors.withColumns({f"c{i}": c.cast("long") if plain else c for i, c in enumerate(from_srgb(F.col("r"), F.col("g"), F.col("b"), o.colorspace))})

    def _distinct(self) -> bool:
        """Whether colours are counted first: sums of sRGB cells do not need it."""
        o = self.options
        return o.dedup_pixels and not (o.colorspace is ColorSpace.SRGB and o.method.kmeans is None)

    def _quantized(self, colors: DataFrame, settle: bool) -> tuple[DataFrame, DataFrame]:
        """(palette in the colour space, boxes). Settled, they are computed here, once for all that asks for them."""
        o = self.options
        whole, scale = o.colorspace is ColorSpace.SRGB, histogram.SCALES[o.colorspace.value]
        kept = settled if settle else lambda df: df
        cells = histogram.moments(colors, default_binner(o.colorspace), ("c0", "c1", "c2"), scale)
        boxes = kept(wu.find_boxes(cells, o.palette_size, 32, scale))
        palette = wu.palette_of(boxes, whole)
        if o.method.kmeans is not None:
            weighted = colors
            if not o.dedup_pixels:  # places are counted by colour; the number of samples by pixel
                weighted = counts.unique_color_counts(self.pixels)
                weighted = weighted.withColumns({f"c{i}": c.cast("double") for i, c in enumerate(from_srgb(F.col("r"), F.col("g"), F.col("b"), o.colorspace))})
            palette = kept(kmeans.palette(weighted, palette, o.method.kmeans, ("c0", "c1", "c2"), whole, weighted=o.dedup_pixels))
        return palette, boxes

    def assigned_colors(self) -> tuple[DataFrame, DataFrame]:
        """(palette in the colour space; distinct colours as image_id, r, g, b, n, c0, c1, c2, palette_idx). Colours and palette are computed once."""
        o = self.options
        colors = cut(self._colors()) if self._distinct() else self._colors()
        palette, boxes = self._quantized(colors, settle=True)
        distinct = colors if self._distinct() else colors.groupBy("image_id", "r", "g", "b", "c0", "c1", "c2").agg(F.sum("n").alias("n"))
        if o.method.kmeans is None:
            return palette, wu.lookup(distinct, boxes, default_binner(o.colorspace), ("c0", "c1", "c2"))
        return palette, nearest.nearest(distinct, palette)

    def _converted(self, palette: DataFrame) -> DataFrame:
        back = to_srgb(F.col("c0"), F.col("c1"), F.col("c2"), self.options.colorspace)
        return palette.select("image_id", "palette_idx", *[c.alias(n) for c, n in zip(back, "rgb", strict=True)], "n")

    def palette(self) -> DataFrame:
        """(image_id, palette_idx, r, g, b, n)."""
        return self._converted(self._quantized(self._colors(), settle=False)[0])


class ImagePipeline(PalettePipeline):
    """Quantised images: pixels, and their images' widths and heights."""

    def __init__(self, pixels: DataFrame, images: DataFrame, options: _Options | None = None, check: bool = True):
        super().__init__(pixels, options)
        self.images = images
        if check:
            have = pixels.groupBy("image_id").agg(F.count("*").alias("have"))
            wrong = images.join(have, "image_id", "left").where(F.coalesce("have", F.lit(0)) != F.col("width") * F.col("height"))
            if not wrong.isEmpty():
                raise ValueError("an image's width times its height is not the number of its pixels")

    @classmethod
    def from_images(cls, images: DataFrame) -> ImagePipeline:
        return cls(image_source.pixels_of(images), images.select("image_id", "width", "height"), check=False)

    def to_palette_pipeline(self) -> PalettePipeline:
        return PalettePipeline(self.pixels, self.options)

    def dither(self, on: bool) -> ImagePipeline:
        return self._with(dither=on)

    def dither_error_diffusion(self, value: float) -> ImagePipeline:
        """A value outside 0..1 stands for 7/8."""
        return self._with(error_diffusion=diffusion.checked_diffusion(value, diffusion.DIFFUSION))

    def indexed_palette(self, rows_per_band: int | None = diffusion.ROWS_PER_BAND) -> QuantizeOutput:
        """The palette, and each pixel's index into it. Distinct colours are assigned, and pixels look their colour up."""
        o = self.options
        palette, assigned = self.assigned_colors()
        indices = counts.remap(self.pixels, assigned)
        if o.dither and o.error_diffusion:
            px = self.pixels.withColumns({f"c{i}": c.cast("double") for i, c in enumerate(from_srgb(F.col("r"), F.col("g"), F.col("b"), o.colorspace))})
            indices = diffusion.dither(px, indices, palette, self.images, o.error_diffusion, ("c0", "c1", "c2"), rows_per_band)
        return QuantizeOutput(self._converted(palette), indices)

    def quantized_pixels(self, rows_per_band: int | None = diffusion.ROWS_PER_BAND) -> DataFrame:
        """(image_id, pos, r, g, b) in palette colours."""
        out = self.indexed_palette(rows_per_band)
        return sinks.quantized_pixels(out.indices, out.palette)

    def quantized_images(self, kind: str = "png", rows_per_band: int | None = diffusion.ROWS_PER_BAND) -> DataFrame:
        return sinks.image_bytes(self.quantized_pixels(rows_per_band), self.images, kind)
