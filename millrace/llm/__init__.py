"""Operators for preparing training data: filters, dedup, tokenizing, scoring."""
