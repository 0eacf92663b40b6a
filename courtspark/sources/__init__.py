"""Schemas, readers, writers and the tracking views of the given tables."""
