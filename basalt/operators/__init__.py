"""Relational, graph, vector and metric operators over DataFrames."""
