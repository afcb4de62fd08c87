"""Readers that end in the canonical samples table."""
