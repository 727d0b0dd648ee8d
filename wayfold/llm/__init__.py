"""Operators for preparing training text: filtering, near-duplicate search, mixing, sharding and formatting."""
