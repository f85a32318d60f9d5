"""tintflow: colour quantisation, palettes and large-table processing on Spark."""

__version__ = "0.1.0"
