"""Operators of the retail engine."""
