"""Operators over pixel and colour tables."""
