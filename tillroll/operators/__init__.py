"""Retail analytics operators: each takes and returns DataFrames."""
