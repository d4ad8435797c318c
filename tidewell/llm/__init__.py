"""Operators for preparing training text: dedup, quality, privacy, packing, search.

The subpackage stands alone: nothing else in the library imports it.
"""
