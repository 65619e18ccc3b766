"""Operators for preparing training data: encoding, cleaning, de-duplication,
mixing, sharding and search.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
