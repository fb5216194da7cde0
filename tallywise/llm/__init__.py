"""Operators of a training-data pipeline: tokenising, filtering, deduplication, mixing and archives.

Nothing else in the library imports this subpackage.  Every operator is a function on
DataFrames with its own general interface; ``queries`` holds the thin ``opN_`` queries.
"""
