"""Corpus operators for language models: tokenisation, packing, quality, safety and near-duplicate detection.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
