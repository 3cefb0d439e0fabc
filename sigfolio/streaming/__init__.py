"""Structured Streaming forms of the signal -> portfolio state."""
