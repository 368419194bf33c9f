"""Readers, writers and generators of atoms and potentials."""
