"""Retail store analytics on Spark: vision events, visits and tills as DataFrame operators."""
