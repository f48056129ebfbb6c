"""Streaming of the retail engine."""
