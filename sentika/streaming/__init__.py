"""Structured Streaming forms of the same work."""
