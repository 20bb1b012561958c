"""Operators for preparing training text: archives, deduplication, filters, placement, mixing and output."""
