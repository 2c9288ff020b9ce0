"""Operators: DataFrames in, one lazy DataFrame of a static schema out."""
