"""Operators for training-data pipelines: deduplication, search, filtering, packing, extraction.

Nothing else in the library imports this subpackage.
"""
