"""Whole workflows and the catalogue of queries."""
