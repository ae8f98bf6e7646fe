"""Operators of locuslake."""
