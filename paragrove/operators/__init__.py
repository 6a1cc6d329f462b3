"""Operators: functions from DataFrames to DataFrames, without global state."""
