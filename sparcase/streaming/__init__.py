"""Structured Streaming: events, journals, outbox and windows."""
