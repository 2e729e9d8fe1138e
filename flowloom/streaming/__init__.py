"""Structured Streaming versions of the flow operators."""
