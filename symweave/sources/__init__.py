"""Readers, writers and the extraction of symbols and edges from source text."""
