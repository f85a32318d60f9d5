"""Builders that put operators together."""

from .pipeline import ImagePipeline, PalettePipeline, QuantizeMethod

__all__ = ["ImagePipeline", "PalettePipeline", "QuantizeMethod"]
