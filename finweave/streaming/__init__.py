"""Structured Streaming forms of event-time operators."""
