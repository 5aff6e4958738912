"""Operators of a training-data pipeline: deduplication, search, packing, extraction and scoring.

Nothing outside this subpackage imports it.
"""
