"""Structured Streaming forms of the replicated state machines."""
