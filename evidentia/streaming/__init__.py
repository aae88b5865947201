"""Incremental versions of the batch aggregates."""
