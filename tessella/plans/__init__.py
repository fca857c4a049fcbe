"""Queries as immutable specifications, and how they become DataFrames."""
