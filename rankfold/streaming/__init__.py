"""Structured Streaming jobs over the request log."""
