"""Operators: functions from DataFrames to DataFrames, always lazy."""
