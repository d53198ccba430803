"""Streaming form of the raw load (the reference itself has no streams)."""

from churnkit.streaming.load import load_counts, stream_raw_csv

__all__ = ["load_counts", "stream_raw_csv"]
