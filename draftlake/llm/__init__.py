"""Operators for large training corpora: tokens, neighbours, secrets, duplicates, quality, shards and packing."""
