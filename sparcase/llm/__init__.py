"""Operators for large-scale training data. Nothing else in this library imports this subpackage."""
