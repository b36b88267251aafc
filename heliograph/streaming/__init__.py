"""Structured Streaming: watching folders, and event-time operators."""
