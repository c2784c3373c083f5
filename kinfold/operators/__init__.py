"""Operators on DataFrames: mapping, quality rules, matching, loading, merging, completeness, sampling and reports."""
