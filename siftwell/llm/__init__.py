"""Training-data operators: ANN search, mixing, sharding, near-dedup, fingerprints,
language ID, token files, licence scans, toxicity and packing.

Nothing outside this subpackage imports it.
"""
