"""Plans of locuslake."""
