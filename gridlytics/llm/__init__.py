"""Operators for preparing training text: filters, near-duplicates, extraction, archives, packing and token files."""
