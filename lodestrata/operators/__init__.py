"""Joins, aggregations and windows over atoms, pairs and trajectories."""
