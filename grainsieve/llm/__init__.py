"""Operators of a training-data pipeline: joins, scans, packing, extraction, encoding and vector search on Spark tables."""
