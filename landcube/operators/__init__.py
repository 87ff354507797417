"""Operators from DataFrame to DataFrame; none collects rows or uses a Python function where a built-in does."""
