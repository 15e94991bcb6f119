"""Structured Streaming jobs and state processors."""
