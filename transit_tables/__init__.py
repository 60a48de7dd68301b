"""Spark operators for public-transport tables."""
