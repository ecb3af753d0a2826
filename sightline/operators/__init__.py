"""Operators over cells, lines of sight, segments and polygons."""
