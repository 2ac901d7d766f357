"""Structured Streaming forms of chunking and packing."""
