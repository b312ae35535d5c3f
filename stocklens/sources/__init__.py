"""Schemas, table readers, writers and the mapping from the benchmark tables."""
