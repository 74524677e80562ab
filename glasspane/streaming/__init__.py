"""Structured Streaming forms of the incremental aggregates."""
