"""Column functions: normalisers, picklists and similarity."""
