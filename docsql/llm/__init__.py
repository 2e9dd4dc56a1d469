"""Operators for preparing training data: screening, deduplication, packing and token output."""
