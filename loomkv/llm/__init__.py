"""Training-data operators: tokenising, fingerprints, near duplicates, quality, secrets, sharding, packing.

Nothing outside this subpackage imports it.
"""
