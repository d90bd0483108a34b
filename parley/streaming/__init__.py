"""Conversations as Structured Streaming jobs."""
