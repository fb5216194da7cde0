"""Crowd-label analytics on Spark."""
