"""Operators on bars, trades, quotes and panels: DataFrames in, DataFrames out."""
