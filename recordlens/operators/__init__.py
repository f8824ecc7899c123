"""Joins, aggregations, ordered analytics and rankings: functions from DataFrames to a DataFrame."""
