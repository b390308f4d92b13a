"""Operators on lattices."""
