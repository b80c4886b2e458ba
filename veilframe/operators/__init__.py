"""Operators on sheets: DataFrames of string columns with a dense row number."""
