"""Training-data operators: deduplication, fingerprints, language ID, tokenising, packing, sharding.

Nothing else in the library imports this subpackage.
"""
