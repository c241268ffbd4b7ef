"""Operators for text and model data. Nothing outside of this package imports it."""
