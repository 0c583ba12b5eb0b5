"""Structured Streaming forms of the point operators."""
