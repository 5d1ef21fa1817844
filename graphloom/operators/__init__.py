"""Operators over graph, metric and finding tables."""
