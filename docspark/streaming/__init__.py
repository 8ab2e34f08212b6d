"""Structured Streaming: the same operators on arriving files."""
