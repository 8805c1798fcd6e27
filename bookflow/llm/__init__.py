"""Operators of a training-data pipeline: cleaning, scoring, deduplication, search and tokenisation.

Nothing else in the library imports this subpackage.
"""
