"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage, and it imports nothing from the rest.
"""
