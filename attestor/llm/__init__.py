"""Operators for preparing training corpora: encoding, sharding, dedup, filtering, packing."""
