"""Granules that arrive as a stream."""
