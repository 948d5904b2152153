"""Structured Streaming: waves of records linked as they arrive."""
