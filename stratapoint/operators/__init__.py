"""Operators of the point-cloud engine."""
