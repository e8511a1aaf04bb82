"""Structured Streaming forms of the updates."""
