"""Operators for preparing training data: extraction, deduplication, scoring, mixing, packing and search."""
