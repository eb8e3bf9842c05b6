"""Operators over DataFrames; columns are named by the caller."""
