"""Operators for training-data corpora: cleaning, deduplication, packing and archives."""
