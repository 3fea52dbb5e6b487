"""Operators for text corpora: extraction, scans, deduplication, packing, scoring and quality rules.

Nothing outside this folder imports it.
"""
