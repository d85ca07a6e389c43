"""Training-data operators: tokenizing, filtering, deduplication and packing.

Nothing else in the library imports this subpackage.
"""
