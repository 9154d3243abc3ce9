"""Queries over the engine's tables, one function each; every function takes and returns DataFrames."""
