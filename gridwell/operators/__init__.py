"""Operators on long tables of gridded daily series."""
