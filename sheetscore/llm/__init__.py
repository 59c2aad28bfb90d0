"""Operators of a training-data pipeline: deduplication, packing, scans, token files, language, search, filters."""
