"""Versioned tables, their differences, merges and profiles as Spark DataFrames."""
