"""Structured Streaming forms of the operators that have a bounded state."""

from .joins import stream_intersect, stream_static_intersect, stream_window
from .merge import stream_merge

__all__ = ["stream_intersect", "stream_merge", "stream_static_intersect", "stream_window"]
