"""Structured Streaming twins of the sequential operators."""
