"""Operators that prepare training text: deduplication, tokens, packing, filters, formatting."""
