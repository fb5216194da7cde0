"""Datasets, run stores and staged tables."""
