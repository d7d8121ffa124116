"""Incremental forms of the statistics."""
