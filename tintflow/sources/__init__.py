"""Where pixels come from and where results go."""

from .pixels import color_slice, empty_pixels, from_table, num_colors, truncated, validated
from .images import benchmark_images, load_image_dir, load_images, pixels_of, read_images
from .sinks import image_bytes, palette_hex, points, quantized_pixels, write_image_files, write_images

__all__ = ["benchmark_images", "color_slice", "empty_pixels", "from_table", "image_bytes", "load_image_dir", "load_images", "num_colors", "palette_hex", "pixels_of", "points", "quantized_pixels", "read_images", "truncated", "validated", "write_image_files", "write_images"]
