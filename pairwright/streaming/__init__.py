"""Structured Streaming entry points for the same operators."""
