"""Relational, graph and integrity operators on DataFrames."""
