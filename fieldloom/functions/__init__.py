"""Site-local functions of columns."""
