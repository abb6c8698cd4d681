"""Operators of a training-data pipeline: duplicates, quality, tokens, mixing, extraction, placement.

Nothing else in the library imports this subpackage. Each module holds one operator; ``workload``
registers one query per operator on the driver tables.
"""
