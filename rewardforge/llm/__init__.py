"""Operators for training-data pipelines: quality, dedup, mixing, filters, sharding.

Nothing outside this package (but ``corpus_pipeline.py``) imports it.
"""
