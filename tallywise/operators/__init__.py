"""Operators on annotation tables."""
