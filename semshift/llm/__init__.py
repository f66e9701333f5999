"""Training-data operators: media, sharding, records, mixing, near-duplicates, substring dedup, tokenizing, classifiers.

Nothing outside this subpackage imports it.
"""
