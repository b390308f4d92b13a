"""Lattice analytics on Spark DataFrames: fields keyed by site coordinates."""
