"""Operators for large text corpora: deduplication, tokens, quality, search, sharding, archives.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing from the rest of the library.
"""
