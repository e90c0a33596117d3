"""Training-data operators: encoding, sharding, mixing, filtering, near-duplicate and secret detection.

Nothing else in the library imports this subpackage.
"""
