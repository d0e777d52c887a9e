"""Structured Streaming jobs. Each has a batch twin with the same answer after a drain."""
