"""Operators for building training data: filters, near-duplicate search, sharding, packing and token files."""
