"""Operators for preparing training data: deduplication, filters, tokenizing, mixing, scoring."""
