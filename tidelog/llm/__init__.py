"""Operators for building training data from a document corpus.

Nothing outside this package imports it.
"""
