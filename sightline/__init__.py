"""Terrain-visibility analytics as Spark DataFrame transformations."""
