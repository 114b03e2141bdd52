"""Operators that prepare training text: quality, duplicates, contamination, shards, packing, ids."""
