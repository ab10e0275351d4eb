"""Structured Streaming twins of the run-state operators."""
