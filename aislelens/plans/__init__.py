"""Plans of the retail engine."""
