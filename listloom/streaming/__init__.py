"""Structured Streaming jobs over growing record logs and request logs."""
