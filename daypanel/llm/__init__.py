"""Operators for preparing training text: deduplication, filters, formatting and tokens."""
