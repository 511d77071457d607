"""Operators: functions from DataFrames to DataFrames, built of Spark's own expressions."""
