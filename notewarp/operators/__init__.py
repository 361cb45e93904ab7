"""Operators on chunks and the index."""
