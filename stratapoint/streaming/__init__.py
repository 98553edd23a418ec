"""Streaming of the point-cloud engine."""
