"""Operators for text and vector corpora: search, deduplication, scans, tokens, extraction."""
