"""Palettes of streams."""

from .palette_stream import final_moments, read_table_as_stream, streaming_moments, write_palettes

__all__ = ["final_moments", "read_table_as_stream", "streaming_moments", "write_palettes"]
