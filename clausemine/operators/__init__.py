"""Relational operators on graphs, paths and rules; each takes and returns DataFrames."""
