"""Structured Streaming over timed operations and match results."""
