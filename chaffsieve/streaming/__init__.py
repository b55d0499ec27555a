"""Structured Streaming forms of the filter."""
