"""Readers, writers and views of the given tables."""
