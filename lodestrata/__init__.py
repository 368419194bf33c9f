"""Interatomic-potential and trajectory analytics as Spark DataFrame operations."""
