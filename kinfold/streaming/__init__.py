"""Incremental and streaming runs of the same operators."""
