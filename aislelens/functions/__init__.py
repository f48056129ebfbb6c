"""Functions of the retail engine."""
