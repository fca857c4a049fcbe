"""Operators on tables as a whole: changes, trees, validation, caching, comparison."""
