"""Training-data operators: deduplication, quality, secrets, tokens, extraction, licences.

Nothing outside this subpackage imports it.
"""
