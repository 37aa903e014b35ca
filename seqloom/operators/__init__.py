"""Operators over sequences, counters, tracks and gene tables; all take and return DataFrames."""
