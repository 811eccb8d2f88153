"""Incremental memorising and event-time windows on Structured Streaming."""
