"""Sources of locuslake."""
