"""Operators for building training corpora: mixing, cleaning, deduplication, scanning and formatting."""
