"""Structured Streaming forms of the event and bar operators."""
