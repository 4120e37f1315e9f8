"""Operators over event, entity and metric DataFrames."""
