"""Structured Streaming: scoring and metrics."""
