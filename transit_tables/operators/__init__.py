"""Operators on feed-keyed tables; each takes and returns DataFrames."""
