"""Operators for large training corpora: dedup, scans, search, tokens, mixing, models."""
