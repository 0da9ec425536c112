"""Operators for preparing training text: scanning, deduplication, scoring, packing, formatting."""
