"""Operators on DataFrames: fusion, classification, identity, joins, deadlines, statistics."""
