"""Training-data operators: deduplication, mixing, scoring, packing and sharding.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
