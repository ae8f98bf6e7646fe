"""Functions of locuslake."""
