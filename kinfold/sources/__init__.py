"""Readers, header contracts, incremental source filters and file sinks."""
