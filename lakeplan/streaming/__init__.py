"""Structured Streaming views of the aggregation operators (an extension)."""

from .windows import windowed_counts  # noqa: F401
