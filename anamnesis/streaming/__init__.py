"""Structured Streaming forms of the live operators and periodic jobs."""
