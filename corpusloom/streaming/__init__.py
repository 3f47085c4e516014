"""Structured Streaming jobs, each with a batch twin that gives the same rows for a finished input."""
