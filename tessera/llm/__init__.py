"""Operators for preparing training text: deduplication, filtering, extraction, scoring and mixing."""
