"""Operators of a training-data pipeline (filters, mixing, dedup, scoring).

Nothing else in the library imports this subpackage.
"""
