"""Operators on DataFrames of log records, traces and series."""
