"""Files and tables as lattices, and typed records."""
