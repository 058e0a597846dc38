"""Readers and sinks."""
from roamlens.sources.tables import load_table, load_tables  # noqa: F401
