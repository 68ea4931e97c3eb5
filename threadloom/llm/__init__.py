"""Operators for preparing training text: scoring, cleaning, deduplication, packing, search.

Nothing else in the library imports this subpackage.
"""
