"""Expressions over columns: colour spaces, binning and distances."""

from .binning import FloatBinner, UIntBinner, default_binner
from .colorspace import ColorSpace, component_ranges, from_srgb, to_srgb
from .metrics import sum_of_squares, squared_distance, squared_distance_arrays

__all__ = ["ColorSpace", "FloatBinner", "UIntBinner", "component_ranges", "default_binner", "from_srgb", "squared_distance", "squared_distance_arrays", "sum_of_squares", "to_srgb"]
