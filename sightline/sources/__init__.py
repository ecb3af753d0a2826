"""Where elevations come from and results go."""
