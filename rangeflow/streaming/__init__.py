"""Structured Streaming forms of additive operators."""
