"""Structured Streaming variants of batch aggregates."""
