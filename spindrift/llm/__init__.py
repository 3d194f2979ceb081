"""Training-data operators: deduplication, language, tokens, mixing, fingerprints.

Nothing outside this subpackage imports it. Its queries are in ``queries.py``.
"""
