"""Grids, lattices, lineage cuts and named factories."""
