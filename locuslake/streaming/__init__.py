"""Streaming of locuslake."""
