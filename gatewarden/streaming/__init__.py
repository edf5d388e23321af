"""Structured Streaming versions of the event-driven jobs."""
