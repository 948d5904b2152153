"""Linkage, profile, graph, career and review operators over DataFrames."""
