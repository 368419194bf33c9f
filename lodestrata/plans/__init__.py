"""Ensembles of configurations evaluated in one job, and what is fitted to them."""
